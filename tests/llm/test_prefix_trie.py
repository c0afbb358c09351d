"""The prefix trie against a plain trie in Python: shared heads, long and repeated conversations, collisions of fingerprints, odd tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from patchloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    children = {p: sum(len(q) == len(p) + 1 for q in below[p]) for p in members}
    out = set()
    for p, m in members.items():
        ends = hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest()
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below[p]), sum((len(members[q]) - 1) * len(q[-1][1]) for q in below[p] if q), ends))
    return out


def got(df, **kw):
    rows = [tuple(r) for r in prefix_trie.nodes(df, **kw).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(seed, convs, most, words):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(5 * convs), convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t else "user", rng.choice(words)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_tries_of_few_words(spark, seed):
    rows = made(seed, 60, 9, ["a", "bb", "ccc", "日本"])
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


@pytest.mark.parametrize("prime", [7, 13])
def test_colliding_fingerprints_are_split(spark, prime):
    # Few values of a fingerprint: nearly every group holds different prefixes, in heads too.
    rows = made(prime, 120, 8, ["a", "b", "c", "d", "e"])
    df = spark.createDataFrame(rows, SCHEMA)
    scanned = prefix_trie._fingerprints(df, prime)
    assert scanned.groupBy("place", "f", "g").agg(F.count_distinct("role", "text").alias("n")).filter("n > 1").count() > 0
    assert got(df, prime=prime) == brute(rows)


def test_snapshots_hang_on_each_other(spark):
    # Every conversation is one turn longer than the one before: paths hang on paths, as deep as there are conversations.
    rows = [(1000 + c, t, "user", f"turn {t}") for c in range(60) for t in range(c + 1)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_a_conversation_over_many_tasks(spark):
    rows = [(300, t, "user", f"t{t % 11}") for t in range(700)] + [(301, t, "user", f"t{t % 11}") for t in range(500)] + made(1, 30, 6, ["x", "y"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(9)
        want = {c: i for i, c in enumerate(sorted(x for x in rows if x[0] == 300), 1)}
        places = prefix_trie._fingerprints(df, prefix_trie.PRIME).filter("conv_id = 300").select("place", "text").collect()
        assert sorted(r.place for r in places) == sorted(want.values()) and all(r.text == f"t{(r.place - 1) % 11}" for r in places)
        assert got(df) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_copies_and_far_ids(spark):
    rows = [(c * 700, t, "user", f"same {t}") for c in range(40) for t in range(3)] + [(9_000_000_000_000 + c, 0, "user", "same 0") for c in range(30)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_odd_tables(spark):
    rows = [(5, None, None, None), (5, None, None, None), (5, 1, "", ""), (105, 0, "user", None), (None, 0, "user", "x"), (7, 0, "user", "z" * 100_000), (8, 0, "user", "z" * 100_000), (200, 3, "a", "b"), (200, 3, "a", "b"), (203, 0, "u", "v"), (204, 0, "u", "v")]
    df = spark.createDataFrame([(*r, 1, 2, "n") for r in rows], SCHEMA + ", depth int, label int, owner string")
    assert got(df) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == set() and got(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == set()
    assert got(spark.createDataFrame([(1, 0, "user", "only")], SCHEMA)) == brute([(1, 0, "user", "only")])
