"""Known wrong pairs that lie within each other, and long paths, do not take a round each."""

import random

import pytest
from pyspark.sql import functions as F
from test_decisions import replay

from patchloom.operators import clusters as cl
from patchloom.operators import decisions as de


def decided(spark, ratings, n, wrong):
    frame = spark.createDataFrame
    members = frame([(i, i, False) for i in range(n)], "id long, cluster_id long, is_upstream boolean")
    out, now = de.decide_in_order(frame(ratings, "a long, b long, msg double, diff double, dlr double"), members, 0.5, 0.8, 0.5, 0.3, false_positives=frame(wrong, "origin long, dest long"))
    return {(r.a, r.b): r.outcome for r in out.collect()}, {r.id: r.cluster_id for r in now.collect()}


def test_wrong_pairs_within_each_other_take_no_round_each(spark, monkeypatch):
    # A chain in order, every second of whose links is known to be wrong: each changes what is left of the next.
    n = 24
    ratings = [(i, i + 1, 0.8 + i / 1000, 0.8 + i / 1000, 1.0) for i in range(n - 1)] + [(i, i + 2, 0.9, 0.8, 1.0) for i in range(n - 2)]
    wrong = [(i, i + 1) for i in range(0, n - 1, 2)] + [(i, i + 2) for i in range(0, n - 2, 3)]
    calls, levels = [], de.spanning_levels
    monkeypatch.setattr(de, "spanning_levels", lambda e: calls.append(1) or levels(e))
    got = decided(spark, ratings, n, wrong)
    assert got == replay(ratings, [(i, i, False) for i in range(n)], 0.5, 0.8, 0.5, 0.3, wrong)
    assert "false_positive" in got[0].values() and len(calls) <= 2


@pytest.mark.parametrize("serial", [500_000, 0])
def test_replayed_and_in_rounds_alike(spark, monkeypatch, serial):
    monkeypatch.setattr(de, "SERIAL", serial)
    rng = random.Random(3)
    n = 30
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(5 * n)})
    ratings = [(a, b, rng.choice([0.7, 0.85, 0.9, 1.0]), rng.choice([0.8, 0.9, 1.0]), 1.0) for a, b in pairs]
    wrong = [(rng.randrange(n), rng.randrange(n)) for _ in range(14)]
    assert decided(spark, ratings, n, wrong) == replay(ratings, [(i, i, False) for i in range(n)], 0.5, 0.8, 0.5, 0.3, wrong)


def test_rounds_of_components_grow_slowly(spark, monkeypatch):
    # A path whose ids rise and fall by turns, where the smallest label goes a few places a round.
    n, writes, write = 300, [], cl._recovery_point
    monkeypatch.setattr(cl, "_recovery_point", lambda df: writes.append(1) or write(df))
    order = [i // 2 if i % 2 else n - 1 - i // 2 for i in range(n)]
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    rows = cl.components(edges).agg(F.min("cluster_id"), F.max("cluster_id"), F.count("*")).first()
    assert tuple(rows) == (0, 0, n) and len(writes) < 40
