"""Blocking, rating and decisions against plain Python on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from patchloom.functions import similarity as sim
from patchloom.operators import clusters as cl
from patchloom.operators import matching as mt

NAMES = ["kernel/sched/core.c", "kernel/sched/cores.c", "kernel/core/sched.c", "mm/slab.c", "mm/slub.c", "README", "Documentation/index.rst", "a", "", "x" * 300]


@pytest.fixture(scope="module")
def patches(spark):
    rng = random.Random(4)
    rows = [(i, rng.sample(NAMES, rng.randint(0, 3)), i % 5 == 0) for i in range(40)]
    return rows, spark.createDataFrame(rows, "id long, affected array<string>, is_revert boolean")


def test_block_exact(patches):
    rows, df = patches
    want = {(a, b) for a, f, _ in rows for b, g, _ in rows if a != b and set(f) & set(g)}
    assert {tuple(r) for r in mt.block_exact(df, df).collect()} == want


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_block_fuzzy(patches, threshold):
    rows, df = patches
    near = {(x, y) for x in NAMES for y in NAMES if sim.token_sort_ratio(x, y) / 100 >= threshold - 1e-9}
    want = {frozenset((a, b)) for a, f, r in rows for b, g, s in rows if a != b and r == s and any((x, y) in near for x in f for y in g)}
    got = [frozenset(r) for r in mt.block_fuzzy(df, df, threshold).collect()]
    assert set(got) == want and len(got) == len(want)


def test_interval_and_reduction(spark, patches):
    _, df = patches
    dated = df.select("id", F.timestamp_seconds(F.col("id") * 43200).alias("author_date"))
    pairs = mt.block_exact(df, df)
    near = {tuple(r) for r in mt.in_interval(pairs, dated, 3).collect()}
    assert near == {(a, b) for a, b in (tuple(r) for r in pairs.collect()) if abs((a - b) // 2) < 3}
    r = mt.reduction(df, df, pairs).first()
    assert r.possible == 1600 and r.candidates == pairs.count() and abs(r.factor - 1600 / r.candidates) < 1e-12


def test_candidates_are_ranked(spark):
    r = spark.createDataFrame([(1, 2, 0.5, 0.5, 1.0), (1, 3, 0.9, 0.2, 1.0), (1, 4, 0.1, 0.9, 1.0), (7, 8, 0.3, 0.3, 1.0)], "a long, b long, msg double, diff double, dlr double")
    got = [(x.a, x.b, x.place) for x in mt.review_order(r).collect()]
    assert got == [(7, 8, 1), (1, 3, 1), (1, 2, 2), (1, 4, 3)]


def test_decisions_answers_and_false_positives(spark):
    r = spark.createDataFrame([(1, 2, 0.9, 0.9, 1.0), (3, 4, 0.7, 0.7, 1.0), (5, 6, 0.9, 0.9, 1.0), (7, 8, 0.9, 0.9, 0.1)], "a long, b long, msg double, diff double, dlr double")
    manual = spark.createDataFrame([(3, 4, True)], "a long, b long, accepted boolean")
    decided = mt.decide(r, 0.5, 0.8, 0.6, 0.4, manual)
    assert {(x.a, x.decision) for x in decided.collect()} == {(1, "accepted"), (3, "accepted"), (5, "accepted"), (7, "skipped")}
    members = spark.createDataFrame([(i, i if i < 5 else 5 if i == 9 else i, False) for i in range(1, 10)], "id long, cluster_id long, is_upstream boolean")
    # 9 is with 5; the false positive begins at 9 and ends at 6, so 5 and 6 stay apart.
    wrong = spark.createDataFrame([(9, 6)], "origin long, dest long")
    got = {x.id: x.cluster_id for x in mt.cluster(decided, members, wrong).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 9: 5, 6: 6, 7: 7, 8: 8}


def test_similar_subjects(spark):
    words = ["fix", "fixes", "memory", "leak", "in", "driver", "drivers", "add", "support"]
    rng = random.Random(3)
    a = [(f"c{i}", " ".join(rng.choices(words, k=4))) for i in range(15)]
    b = [(f"m{i}", " ".join(rng.choices(words, k=rng.randint(3, 5)))) for i in range(25)]
    got = {tuple(r) for r in mt.similar_subjects(spark.createDataFrame(a, "id string, subject string"), spark.createDataFrame(b, "id string, subject string")).collect()}
    assert got == {(i, j) for i, s in a for j, t in b if sim.ratio(s, t) > 80} and got


def test_successors_and_consecutive(spark):
    stacks = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "ord int, id long")
    patches = spark.createDataFrame([(10, ["a"]), (11, ["a"]), (20, ["a"]), (30, ["a"])], "id long, affected array<string>")
    assert {tuple(r) for r in mt.successor_pairs(stacks, patches).collect()} == {(10, 11), (11, 10), (10, 20), (11, 20), (20, 30)}


def test_adjusted_mutual_information(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 3), rng.randint(0, 4)) for i in range(60)]
    table = cl.contingency(spark.createDataFrame([(i, t) for i, t, _ in rows], "id int, cluster_id int"), spark.createDataFrame([(i, p) for i, _, p in rows], "id int, cluster_id int"))
    import math
    from collections import Counter

    n = len(rows)
    t, p, both = Counter(x[1] for x in rows), Counter(x[2] for x in rows), Counter(x[1:] for x in rows)
    h = lambda c: -sum(v / n * math.log(v / n) for v in c.values())
    mi = h(t) + h(p) - h(both)
    emi = cl.expected_mutual_information(list(t.values()), list(p.values()))
    assert abs(cl.adjusted_mutual_information(table).first().ami - (mi - emi) / ((h(t) + h(p)) / 2 - emi)) < 1e-9


def test_ids_of_one_side_count(spark):
    truth = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, cluster_id int")
    predicted = spark.createDataFrame([(1, 7), (2, 7), (9, 7)], "id int, cluster_id int")
    r = cl.pair_counts(cl.contingency(truth, predicted)).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 2, 0, 3)


def test_cluster_edits(spark):
    m = spark.createDataFrame([(1, 1, False), (2, 1, True), (3, 3, False), (4, 3, False), (5, 5, False)], "id long, cluster_id long, is_upstream boolean")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    as_dict = lambda df: {r.id: r.cluster_id for r in df.collect()}
    assert as_dict(cl.rip_up(m, spark.createDataFrame([(3,)], "cluster_id long"))) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert as_dict(cl.remove(m, ids(2, 5))) == {1: 1, 3: 3, 4: 3}
    assert {r.id for r in cl.mark_upstream(m, ids(4)).filter("is_upstream").collect()} == {2, 4}
    groups = spark.createDataFrame([("g", 2), ("g", 4), ("h", 8), ("h", 9)], "group string, id long")
    assert as_dict(cl.insert(m, groups)) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 8: 8, 9: 8}
    assert {r.id for r in cl.unreachable(m, ids(1, 2, 3)).collect()} == {4, 5}


def test_rating_by_blocks(spark, monkeypatch):
    """Many patches of one file in blocks of a few, copies among them, across files, equal ids, nulls and pairs given twice."""
    monkeypatch.setattr(mt, "BLOCK", 3)
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choices(["fix", "leak", "é", "ß", "Größe", "x_y", "driver", "\U0001f600", "é"], k=n))
    rows = []
    for i in range(30):
        hunks = [(f"h{rng.randint(0, 2)}", [some(3)] * rng.randint(0, 2), [some(2)] * rng.randint(0, 2)) for _ in range(rng.randint(0, 3))]
        name = rng.choice(["hot", "hot", "hot", "a", "b"])
        rows.append((i, [name] if i % 7 else None, rng.choice([None, "", some(4), "copy copy"]), rng.randint(0, 6), [(name, rng.choice([0, 0, 90, 100]), hunks)] if i % 11 else None))
    schema = "id int, affected array<string>, message string, lines int, files array<struct<name string, similarity int, hunks array<struct<heading string, insertions array<string>, deletions array<string>>>>>"
    patches = spark.createDataFrame(rows, schema)
    pairs = spark.createDataFrame([(a, b) for a in range(30) for b in range(a, 30, 2)] + [(0, 2), (0, 99)], "a int, b int")
    got = {(r.a, r.b): (r.msg, r.diff, r.dlr) for r in mt.rate(pairs, patches, 0.4, 1.0, 1.0).collect()}

    def diff(files):
        return mt._diff([dict(zip(("name", "similarity", "hunks"), (n, s, [dict(zip(("heading", "insertions", "deletions"), h, strict=True)) for h in hs]), strict=True)) for n, s, hs in files or []])

    want = {}
    for a in range(30):
        for b in range(a, 30, 2):
            x, y = rows[a], rows[b]
            dlr = 1.0 if x[3] == y[3] == 0 else min(x[3], y[3]) / max(x[3], y[3])
            rated = (sim.token_sort_ratio(x[2] or "", y[2] or "") / 100, sim.rate_diffs(diff(x[4]), diff(y[4]), 1.0, 1.0), dlr)
            want[a, b] = (1.0, 1.0, 1.0) if a == b else rated if dlr >= 0.4 else (0.0, 0.0, dlr)
    assert got == want
    sizes = [r["count"] for r in mt.blocks(patches).groupBy("file", "chunk").count().collect()]
    assert sum(sizes) == 30 and len(sizes) > 6
