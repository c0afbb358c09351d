"""Few edges are contracted by one task, in the same rounds and to the same forest as by joins."""

import random

import pytest
from pyspark.sql import functions as F

from patchloom.operators import clusters as cl
from patchloom.operators import decisions as de


def _edges(spark, n=60, m=90):
    rng = random.Random(3)
    rows = [(rng.choice([0.5, 1.0]), rng.randrange(n), rng.randrange(n), rng.randrange(5)) for _ in range(m)]
    df = spark.createDataFrame(rows, "w double, a long, b long, r int").distinct()
    return df.select(F.struct("w", F.col("a").alias("id")).alias("u"), F.struct("w", F.col("b").alias("id")).alias("v"), F.struct("r", "w", "a", "b").alias("rank"))


@pytest.mark.parametrize("tail", [0, 20, 500_000])
def test_tail_gives_the_forest_and_parts_of_the_rounds(spark, monkeypatch, tail):
    edges = cl._recovery_point(_edges(spark))
    parent, forest = {}, set()

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in sorted(edges.collect(), key=lambda r: r["rank"]):
        x, y = top(r["u"]), top(r["v"])
        if x != y:
            parent[max(x, y)] = min(x, y)
            forest.add(r["rank"])
    monkeypatch.setattr(cl, "TAIL", tail)
    levels = cl.spanning_levels(edges)
    assert {r["rank"] for r in de.spanning_forest(edges, levels).collect()} == forest
    assert {r["id"]: r["cluster_id"] for r in cl.tree_labels(levels, edges.schema["u"].dataType).collect()} == {x: top(x) for x in parent if any(x in (r["u"], r["v"]) and r["u"] != r["v"] for r in edges.collect())}


def test_a_path_is_not_written_again_and_again(spark, monkeypatch):
    steps, write = [], cl._recovery_point
    monkeypatch.setattr(cl, "_recovery_point", lambda df: steps.append(df) or write(df))
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert cl.components(path).select("cluster_id").distinct().collect() == [(0,)]
    assert len(steps) <= 3
