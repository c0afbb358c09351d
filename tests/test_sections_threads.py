"""Section patterns, hops and communities; threads with cycles, unknown parents and deep chains; mail predicates."""

import fnmatch
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.functions import characteristics as ch
from patchloom.functions import text as tx
from patchloom.operators import evolution as ev
from patchloom.operators import reports as rp
from patchloom.operators import sections as se
from patchloom.operators import threads as th

TREE = ["Makefile", "kernel/fork.c", "kernel/sched/core.c", "drivers/net/a.c", "drivers/net/b.h", "drivers/usb/x.c", "net/core/dev.c"]


def test_files_of_sections(spark):
    rows = [("k", "F", "kernel/"), ("k", "X", "kernel/sched/"), ("sched", "F", "kernel/sched"), ("net", "F", "drivers/net/*.c"), ("net", "F", "net/"), ("c", "F", "*/*.c"), ("n", "N", "usb*"), ("one", "F", "Makefile"), ("gone", "F", "missing/file.c"), ("none", "X", "Makefile")]
    patterns = se.valid_patterns(spark.createDataFrame(rows, "section string, kind string, pattern string"), spark.createDataFrame([(x,) for x in TREE], "path string"))
    got = {tuple(r) for r in se.files_of_sections(spark.createDataFrame([(x,) for x in TREE], "path string"), patterns).collect()}
    assert got == {
        ("kernel/fork.c", "k"), ("kernel/sched/core.c", "sched"), ("drivers/net/a.c", "net"), ("net/core/dev.c", "net"), ("kernel/fork.c", "c"), ("drivers/usb/x.c", "n"), ("Makefile", "one"),
    }


def test_patterns_equal_a_test_of_every_file(spark):
    rng = random.Random(12)
    part = lambda: rng.choice(["net", "usb", "drivers", "a.c", "core.h", "x1", "Makefile", "net-usb"])
    paths = sorted({"/".join(part() for _ in range(rng.randint(1, 4))) for _ in range(200)})
    wild = lambda w: rng.choice([w, w, "*", w[0] + "*", "?" + w[1:], "*" + w[-2:]])
    globs = sorted({"/".join(wild(part()) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "/"]) for _ in range(120)})
    globs = [g for g in globs if "*" in g or "?" in g]
    names = ["usb", "net-usb", "u.b", "(usb|x1)/", "core*", "x1", "[ad]\\.c", "ers/n", "gone from here"]
    rows = [(f"s{i}", "F", g) for i, g in enumerate(globs)] + [(f"n{i}", "N", n) for i, n in enumerate(names)] + [("s0", "X", "net/"), ("s1", "X", "*/usb")]
    tree = spark.createDataFrame([(x,) for x in paths], "path string")
    patterns = se.valid_patterns(spark.createDataFrame(rows, "section string, kind string, pattern string"), tree)

    def hit(kind, pattern, path):
        if kind == "N":
            return re.search(pattern.rstrip("*"), path) is not None
        p, q = pattern.rstrip("/").split("/"), path.split("/")
        return (len(q) > len(p) if pattern.endswith("/") else len(q) == len(p)) and all(fnmatch.fnmatchcase(y, x) for x, y in zip(p, q, strict=False))

    sections = {s for s, _, _ in rows}
    want = {(x, s) for x in paths for s in sections if any(hit(k, g, x) for t, k, g in rows if t == s and k != "X") and not any(hit(k, g, x) for t, k, g in rows if t == s and k == "X")}
    out = se.files_of_sections(tree, patterns)
    assert {tuple(r) for r in out.collect()} == want and len(want) > 200
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_hops_of_a_long_chain(spark):
    edges = spark.range(66).selectExpr("id AS src", "id + 1 AS dst")
    pairs = spark.createDataFrame([(1, 0, 66), (2, 1, 60), (3, 5, 5)], "key int, a long, b long")
    assert {r.key: r.hops for r in se.hops(edges, pairs).collect()} == {1: 66, 2: 59, 3: 0}


def test_hops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    pairs = spark.createDataFrame([(1, "a", "d"), (1, "a", "c"), (2, "a", "a"), (3, "a", "y"), (4, "y", "x")], "key int, a string, b string")
    assert {r.key: r.hops for r in se.hops(edges, pairs).collect()} == {1: 2, 2: 0, 4: 1}


def test_communities_of_two_cliques(spark):
    one, two = "abcd", "wxyz"
    rows = [(p, q, 10) for g in (one, two) for i, p in enumerate(g) for q in g[i + 1 :]] + [("a", "w", 1), ("a", "a", 99)]
    got = {r.section: r.group for r in se.communities(spark.createDataFrame(rows, "src string, dst string, lines long")).collect()}
    assert got == {**dict.fromkeys(one, "a"), **dict.fromkeys(two, "w")}


def _one_merge_at_a_time(edges):
    """Walktrap in plain Python: walks as rows of a matrix power, the nearest neighbouring groups merged, the best modularity kept."""
    weight = {}
    for s, t, w in edges:
        if s != t and w > 0:
            weight[min(s, t), max(s, t)] = weight.get((min(s, t), max(s, t)), 0) + w
    names = sorted({x for e in weight for x in e})
    at = {x: i for i, x in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for (s, t), w in weight.items():
        a[at[s], at[t]] = a[at[t], at[s]] = w
    loops = a + np.diag(a.sum(1) / (a > 0).sum(1))
    d = loops.sum(1)
    walks = np.linalg.matrix_power(loops / d[:, None], se.STEPS) / np.sqrt(d)
    groups, total = {x: [at[x]] for x in names}, a.sum()

    def cost(g, h):
        m, n = groups[g], groups[h]
        return round(((walks[m].mean(0) - walks[n].mean(0)) ** 2).sum() * len(m) * len(n) / (len(m) + len(n)), 12), g, h

    def quality():
        return round(sum(a[np.ix_(m, m)].sum() / total - (a[m].sum() / total) ** 2 for m in groups.values()), 9)

    best, found = quality(), {names[i]: g for g, m in groups.items() for i in m}
    while True:
        near = [cost(g, h) for g in groups for h in groups if g < h and a[np.ix_(groups[g], groups[h])].any()]
        if not near:
            return found
        _, g, h = min(near)
        groups[g] += groups.pop(h)
        if quality() > best:
            best, found = quality(), {names[i]: k for k, m in groups.items() for i in m}


def test_communities_are_those_of_one_merge_at_a_time(spark):
    rng = random.Random(6)
    # Two small graphs, one of them in two parts, and a star.
    edges = [(f"x{i}", f"x{j}", rng.choice([1, 1, 2, 7])) for i in range(8) for j in range(i) if rng.random() < (0.8 if i // 4 == j // 4 else 0.15)]
    edges += [(f"y{i}", f"y{j}", rng.randint(1, 9)) for i in range(4) for j in range(i)] + [("hub", f"leaf{i}", 1 + i) for i in range(3)]
    got = {r.section: r.group for r in se.communities(spark.createDataFrame(edges, "src string, dst string, lines long"), in_order=True).collect()}
    assert got == _one_merge_at_a_time(edges)


def test_section_without_files_has_weight_zero(spark):
    graph = spark.createDataFrame([("a", "a", 4, 1), ("a", "b", 2, 1)], "src string, dst string, lines long, files long")
    got = {tuple(r) for r in se.with_lonely(graph, spark.createDataFrame([("a",), ("b",)], "section string")).collect()}
    assert got == {("a", "a", 4, 1), ("a", "b", 2, 1), ("b", "b", 0, 0)}


def _walk(parent):
    """Roots, depths and subtrees by following parents; a cycle is cut at its smallest id."""
    known = {k: p if p in parent and p != k else None for k, p in parent.items()}
    for k in sorted(known):
        seen, at = [], k
        while at is not None and at not in seen:
            seen.append(at)
            at = known[at]
        if at is not None:
            known[min(seen[seen.index(at) :])] = None
    out = {}
    for k in known:
        path = [k]
        while known[path[-1]] is not None:
            path.append(known[path[-1]])
        out[k] = path
    return out


@pytest.fixture(scope="module")
def mails():
    rng = random.Random(8)
    parent = {f"m{i:02}": f"m{rng.randint(0, i):02}" if rng.random() < 0.8 else None for i in range(40)}
    parent |= {f"c{i:02}": f"c{(i + 1) % 3:02}" for i in range(3)} | {"t": "c01", "u": "gone"} | {f"d{i:02}": f"d{i - 1:02}" if i else None for i in range(30)}
    return parent, {k: rng.choice("xyz") for k in parent}


def test_threads(spark, mails):
    parent, author = mails
    df = spark.createDataFrame([(k, p, author[k]) for k, p in parent.items()], "id string, parent string, author string")
    paths = _walk(parent)
    assert {r.id: (r.root, r.depth) for r in th.roots(df).collect()} == {k: (p[-1], len(p) - 1) for k, p in paths.items()}
    below = {k: [q for q, p in paths.items() if k in p] for k in paths}
    assert {r.id: r.size for r in th.sizes(df).collect()} == {k: len(v) for k, v in below.items()}
    assert {r.id: r.foreign_response for r in th.foreign_response(df).collect()} == {k: any(author[q] != author[k] for q in v) for k, v in below.items()}
    order = sorted(paths, key=lambda k: paths[k][::-1])
    place = {}
    for k in order:
        place[k] = sum(paths[q][-1] == paths[k][-1] for q in place) + 1
    assert {r.id: r.position for r in th.preorder(df).collect()} == place
    starts = spark.createDataFrame([("m00",), ("d10",)], "start string")
    assert {(r.start, r.id, r.depth) for r in th.expand(df, starts).collect()} == {(s, q, len(paths[q]) - len(paths[s])) for s in ("m00", "d10") for q in below[s]}


def test_a_long_chain_takes_two_numbers_a_mail(spark):
    n = 3000
    rows = spark.range(n).selectExpr("format_string('m%05d', id) AS id", "CASE WHEN id > 0 THEN format_string('m%05d', id - 1) END AS parent")
    got = th.preorder(rows).agg(F.min(F.col("position") - F.substring("id", 2, 5).cast("int")), F.max(F.col("position") - F.substring("id", 2, 5).cast("int")), F.count("*")).first()
    assert tuple(got) == (1, 1, n)


def test_parents_and_edges(spark):
    rows = [("a", []), ("b", ["x", "a"]), ("c", ["y", "x"]), ("d", ["x"]), ("e", ["e", "b", "a"])]
    df = spark.createDataFrame(rows, "id string, references array<string>")
    assert {r.id: r.parent for r in th.parents(df).collect()} == {"a": None, "b": "a", "c": "x", "d": None, "e": "b"}
    edges = th.reply_edges(df.withColumnRenamed("references", "replies"))
    assert {(r.parent, r.id) for r in edges.collect()} == {(None, "a"), ("x", "b"), ("a", "b"), ("y", "c"), ("x", "c"), ("x", "d"), ("b", "e"), ("a", "e")}


MAIL = {"id": 1, "email": "a@b.c", "subject": "fix", "user_agent": None, "mailer": None, "patchwork_hint": None, "stable_header": None, "lists": [], "recipients": [], "message": "text", "is_patch": True, "in_project": True, "depth": 0}
SCHEMA = "id long, email string, subject string, user_agent string, mailer string, patchwork_hint string, stable_header string, lists array<string>, recipients array<string>, message string, is_patch boolean, in_project boolean, depth int"


@pytest.mark.parametrize(
    ("change", "kind"),
    [
        ({}, "patch"), ({"depth": 2}, "not-first"), ({"subject": "[RFC] x"}, "process"), ({"in_project": False, "subject": "rfc"}, "not-project"), ({"email": "bot@kernelci.org", "in_project": False}, "bot"),
        ({"email": "lkp@intel.com"}, "patch"), ({"email": "lkp@intel.com", "patchwork_hint": "ignore"}, "bot"), ({"email": "akpm@linux-foundation.org", "user_agent": "s-nail v1"}, "bot"), ({"subject": 'patch "x" added to y'}, "bot"),
        ({"lists": ["linux-next"]}, "linux-next"), ({"lists": ["linux-next"], "email": "sfr@canb.auug.org.au"}, "bot"), ({"stable_header": "Review"}, "stable-review"), ({"lists": ["stable"], "message": "This is a note\nCommit abc\nupstream."}, "stable-review"),
        ({"lists": ["stable"]}, "patch"), ({"is_patch": False}, "other"), ({"is_patch": False, "email": "x@y", "subject": "oe-core cve metrics"}, "bot"), ({"email": "syzbot+1@syzkaller.appspotmail.com"}, "bot"), ({"subject": None, "lists": None, "recipients": None, "message": None, "email": None}, "patch"),
    ],
)
def test_types(spark, change, kind):
    row = MAIL | change
    assert ch.characterise(spark.createDataFrame([tuple(row.values())], SCHEMA)).first().type == kind


def test_cover_letters(spark):
    rows = [(tuple((MAIL | {"is_patch": p, "subject": s}).values())) for p, s in ((False, "[PATCH v2 00/12] x"), (True, "[PATCH 0/2] x"), (False, "Re: x"))]
    assert [r.cover_letter for r in ch.characterise(spark.createDataFrame(rows, SCHEMA)).collect()] == [True, False, False]


def test_ignored_looks_at_the_cluster(spark):
    mails = spark.createDataFrame([("a", "patch", False), ("b", "patch", True), ("c", "patch", False), ("d", "patch", False), ("e", "bot", False), ("f", "patch", False)], "id string, type string, foreign_response boolean")
    members = spark.createDataFrame([("a", 1, False), ("b", 1, False), ("c", 2, False), ("u", 2, True), ("d", 3, False), ("e", 3, False)], "id string, cluster_id int, is_upstream boolean")
    got = {r.id: (r.ignored, r.related) for r in ch.ignored(mails, members).collect()}
    assert got == {"a": (True, False), "b": (False, False), "c": (False, False), "d": (True, True), "e": (None, None), "f": (True, True)}


def test_tags_and_message(spark):
    lines = ["Fixes: not a tag here", "Fixes: not a tag here", "", "signed-off-by : A <a@b>", "Nonsense-by: x", "LINK: https://lkml.kernel.org/1", "body"]
    r = spark.createDataFrame([(lines,)], "l array<string>").select(tx.tags(F.col("l")).alias("t"), tx.without_tags(F.col("l")).alias("m"), tx.archive_links(tx.tags(F.col("l"))).alias("a")).first()
    assert [(t.name, t.value) for t in r.t] == [("fixes", "not a tag here"), ("signed-off-by", "A <a@b>"), ("link", "https://lkml.kernel.org/1")]
    assert r.m == ["Fixes: not a tag here", "Nonsense-by: x", "body"] and r.a == ["https://lkml.kernel.org/1"]


def test_repaired_ids(spark):
    rows = [(["<a@b>"],), (["x", " long.id @host"],), (["short"],), (["<broken id@h> rest"],), ([],), (None,)]
    got = [r.i for r in spark.createDataFrame(rows, "h array<string>").select(tx.repair_message_id(F.col("h")).alias("i")).collect()]
    assert got == ["<a@b>", "<long.id@host>", None, "<brokenid@h>", None, None]


def test_glob_is_like_a_shell_within_components(spark):
    patterns = ["drivers/*.c", "a?c", "x/", "*.h", "a+b/(c).c"]
    paths = ["drivers/a.c", "drivers/net/a.c", "abc", "x/y/z", "b.h", "a+b/(c).c"]
    r = {p: spark.createDataFrame([(p,)], "p string").select(tx.glob_to_regex(F.col("p")).alias("r")).first().r for p in patterns}
    for p in patterns:
        for path in paths:
            want = path.startswith(p) if p.endswith("/") else path.count("/") == p.count("/") and fnmatch.fnmatchcase(path, p.replace("(", "[(]"))
            assert bool(re.match(r[p], path)) == want, (p, path)


def test_asof(spark):
    rows = spark.sql("SELECT id, timestamp_seconds(id * 7000) AS at FROM range(0, 400)")
    marks = spark.sql("SELECT concat('v', id) AS tag, timestamp_seconds(100000 + id * id * 90000) AS since FROM range(0, 5)")
    times = [(100000 + i * i * 90000, f"v{i}") for i in range(5)]
    want = {i: max(t for t in times if t[0] <= i * 7000)[1] for i in range(400) if i * 7000 >= 100000}
    assert {r.id: r.tag for r in rp.asof(rows, marks, "at", "since", "tag").collect()} == want


def test_mails_of_commits(spark):
    members = spark.createDataFrame([("c1", 1), ("m1", 1), ("c2", 2), ("c3", 3), ("m3", 3)], "id string, cluster_id int")
    commits, sent = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "id string"), spark.createDataFrame([("m1",), ("m3",)], "id string")
    dates = spark.sql("SELECT id, timestamp_seconds(t) AS ts FROM VALUES ('c1', 1000000), ('m1', 0), ('c3', 0), ('m3', 1000000) AS x(id, t)")
    assert {r.id: r.found for r in ev.with_mails(commits, members, sent).collect()} == {"c1": True, "c2": False, "c3": True}
    assert {r.id: r.found for r in ev.with_mails(commits, members, sent, dates, True).collect()} == {"c1": True, "c2": False, "c3": False}
