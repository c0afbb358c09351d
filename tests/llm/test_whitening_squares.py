"""The whitening query's deviation, the exact sum of squares that its contract names, against whole numbers of any size."""

import numpy as np

from patchloom.llm import whitening
from patchloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def squares(rows):
    """n and {id: sum of (n * x - s)^2} in Python's whole numbers."""
    x = {i: tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for i, v in rows}
    fit = set(x.values())
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    return n, {i: sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for i, v in x.items()}


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, want = squares([(r.vec_id, r.embedding) for r in rows])
    got = QUERIES["op12_whitening"](spark, SF).collect()
    assert {(r.vec_id, r.n, r.deviation) for r in got} == {(i, n, d) for i, d in want.items()}


def test_large_entries_stay(spark):
    # Finite entries of 2^42 and more are no reason to drop a row; those of 1e300 have no whole number of 64 bits.
    rows = [(1, [2.0**50, 1.0]), (2, [2.0**50 + 3, -1.0]), (3, [2.0**50 - 5, 0.25]), (3, [2.0**50 - 5, 0.25])]
    n, want = squares(rows)
    got = whitening.whiten(spark.createDataFrame([*rows, (4, [1e300, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert n == 3 and {(r.vec_id, r.n, r.squares) for r in got} == {(i, n, d) for i, d in want.items()} and len(got) == 8


def test_sums_beyond_64_bits(spark):
    rows = [(1, [2.0**56, 1.0]), (2, [-(2.0**56), 1.0]), (3, [0.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, want = squares(rows)
    assert {(r.vec_id, r.n, r.squares) for r in got} == {(i, n, d if d < 2**63 else None) for i, d in want.items()}
