"""Whitening against plain numpy over distinct vectors in exact fractions, and on odd tables."""

from fractions import Fraction

import numpy as np
import pytest

from patchloom.llm import whitening
from patchloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, k=16):
    """{id: (deviation, whitened up to sign)}, explained, n by numpy on the distinct vectors."""
    x = {i: tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(t, n) for t in s]
    centred = np.array([[float(c - m) for c, m in zip(v, mean, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {i: (sum(n * c - t for c, t in zip(v, s, strict=True)), np.array([float(c - m) for c, m in zip(v, mean, strict=True)]) @ vectors / np.sqrt(values)) for i, v in x.items()}
    return out, values / np.trace(centred.T @ centred / n), n


def held(got, rows, k=16):
    want, explained, n = brute(rows, k)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(want) and all(sorted(x) == list(range(1, len(explained) + 1)) for x in by.values())
    sign = {}
    for i, (deviation, whitened) in want.items():
        for c, w in enumerate(whitened, 1):
            r = by[i][c]
            assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained[c - 1], rel=1e-4) and r.identity_error <= 1e-4
            if abs(w) > 1e-3:
                assert r.whitened * sign.setdefault(c, np.sign(r.whitened * w)) == pytest.approx(w, rel=1e-6, abs=1e-8)


def test_query_equals_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    held(QUERIES["op12_whitening"](spark, SF).collect(), [(r.vec_id, r.embedding) for r in rows])


def test_covariance_over_distinct_vectors(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))).round(3)
    # A vector that most rows repeat, in parts that are far from the mean.
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, (x[0] * 1).tolist()) for i in range(900)]
    odd = [(5000, None), (5001, [float("nan")] * 20), (5002, [None] + [1.0] * 19), (5003, [float("-inf")] + [1.0] * 19), (5004, [1.0]), (5005, []), (5006, [1e300] * 20)]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows + odd], "vec_id long, embedding array<double>, component int, n string").repartition(7)
    held(whitening.whiten(df).collect(), rows)


def test_odd_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [])]) == []
    one = make([(1, [0.5, 2.0]), (None, [0.5, 2.0]), (1, [0.5, 2.0])])
    assert len(one) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 for r in one)
    flat = make([(i, [float(i), 7.0]) for i in range(5)])
    assert [r.whitened is None for r in flat] == [False, True] * 5 and all(r.identity_error < 1e-9 for r in flat)
    assert sorted(r.component for r in flat) == [1] * 5 + [2] * 5


def test_far_from_nought(spark):
    # Whole numbers far above the spread: what plain doubles would round away.
    rows = [(i, [2.0**36 + i / 64, 2.0**36 + (i * i % 7) / 64]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    held(whitening.whiten(df).collect(), rows)
