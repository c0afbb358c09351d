import math
import random

from patchloom.operators import clusters as cl
from patchloom.operators import threads as th

PREDICTED = [0] * 6 + [6] * 6 + [12] * 5
TRUTH = {i: n for n, g in enumerate(({0, 2, 3, 4, 5, 6, 12, 14}, {1, 7, 8, 9, 11}, {10, 13, 15, 16})) for i in g}


def test_published_example(spark):
    truth = spark.createDataFrame(sorted(TRUTH.items()), "id int, cluster_id int")
    predicted = spark.createDataFrame(list(enumerate(PREDICTED)), "id int, cluster_id int")
    table = cl.contingency(truth, predicted)
    r = cl.pair_counts(table).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (20, 20, 24, 72)
    s = cl.entropy_scores(table).first().asDict()
    want = {"homogeneity": 0.3715, "completeness": 0.3579, "v_measure": 0.3646, "mutual_information": 0.3919, "purity": 0.7059, "adjusted_rand": 0.2429, "fowlkes_mallows": 0.4767}
    assert all(math.isclose(s[k], v, abs_tol=6e-5) for k, v in want.items())


def test_components_of_chain_and_loner(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in (*range(1, 21), 99)], "id int")
    got = {r.id: r.cluster_id for r in cl.components(edges, nodes).collect()}
    assert got == {**dict.fromkeys(range(1, 21), 1), 99: 99}


def test_thread_with_cycle_and_unknown_parent(spark):
    mails = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("u", "gone")], "id string, parent string")
    got = {r.id: r.root for r in th.roots(mails).collect()}
    assert got["c"] == "a" and got["u"] == "u" and set(got) == {"a", "b", "c", "x", "y", "u"}


def test_versions_equal_whole_clusterings(spark, tmp_path):
    rng = random.Random(3)
    rounds = [[(rng.randrange(60), rng.randrange(60 + 5 * k)) for _ in range(12)] for k in range(4)]
    store = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first = cl.components(frame(rounds[0]), spark.range(60))
    cl.write_version(first, None, store, 0)
    for k, edges in enumerate(rounds[1:], 1):
        cl.write_version(first, frame(edges), store, k)
    # A version that is written again changes nothing.
    cl.write_version(first, frame(rounds[2]), store, 2)
    for k in range(4):
        every = [e for r in rounds[: k + 1] for e in r]
        ids = sorted({*range(60), *(b for _, b in every)})
        want = cl.components(frame(every), spark.createDataFrame([(i,) for i in ids], "id long"))
        assert {tuple(r) for r in cl.at_version(spark, store, k).collect()} == {tuple(r) for r in want.collect()}
