"""Spot signatures against plain Python: signatures as chains of words, edited texts, the next document, and all similar pairs."""

import hashlib
import re
from itertools import combinations, islice

import pytest
from pyspark.sql import functions as F

from patchloom.llm import spot_signatures as spot
from patchloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def chains(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    if not words:
        return {text}
    common = set(spot.ANCHORS)
    if not any(w in common for w in words):
        return {tuple(words[i : i + 3]) for i in range(len(words))}
    out = set()
    for i, w in enumerate(words):
        if w in common:
            out.add((w, *islice((words[j] for j in range(i + 1, len(words)) if words[j] not in common), 2)))
    return out


def alike(a, b):
    a, b = chains(a), chains(b)
    return len(a & b) / len(a | b)


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), alike(t, edited), alike(t, after), len(chains(t)))
    return out


def held(got, rows):
    want = brute(rows)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        n, sha, edited, after, size = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.n_signatures) == (n, sha, size) and len(r.fingerprint) == 16 * size
        assert r.near_edited == pytest.approx(edited) and r.near_next == pytest.approx(after)


def test_query_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_spot_signatures"](spark, SF).collect()
    held(got, rows)
    by = {}
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert by.setdefault(text, r.fingerprint) == r.fingerprint


def test_odd_tables(spark):
    long = " ".join(f"the word{i % 977} of thing{i % 31}" for i in range(6000))
    rows = [(3, None), (4, ""), (5, long), (6, long), (7, "!!"), (8, "??"), (9, "no anchors"), (None, "The cat sat on the mat, of 日本語 \U0001f600\U0001f600\U0001f600 too"), (12, "the"), (13, "x"), (-5, "a\n\nb c d")]
    df = spark.createDataFrame([(i, t, 1, "n", 2) for i, t in rows], "doc_id long, text string, n int, h string, task int").repartition(5)
    held(spot.compare(df).collect(), rows)
    make = lambda r: spot.compare(spark.createDataFrame(r, "doc_id long, text string"))
    assert make([]).count() == 0
    one = make([(1, "just one of a kind")]).collect()
    held(one, [(1, "just one of a kind")])
    assert one[0].near_next == 1
    # A row that repeats has the place of the first; other texts of one key are documents of their own.
    again = make([(1, "same of all"), (1, "same of all"), (1, "other in part"), (2, "next to that")]).collect()
    assert len(again) == 4 and len({(r.n_chars, r.edited_sha256) for r in again}) == 3


def test_near_duplicates_are_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = rows[3][1]
    words = base.split(" ")
    rows += [(10_000 + i, " ".join(words[: 3 * i] + words[3 * i + 2 :])) for i in range(30)] + [(20_000, base), (20_001, base + " ")]
    member, pairs = spot.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {r.doc_id: r.set_id for r in member.collect()}
    got = {(r.a, r.b): r.likeness for r in pairs.collect()}
    sets = {of[i]: frozenset(chains(t or "")) for i, t in rows}
    assert len(set(sets.values())) == len(sets)
    want = {}
    for a, b in combinations(sorted(sets), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= spot.THRESHOLD:
            want[a, b] = j
    assert len(want) > 100 and got == pytest.approx(want)


def test_no_python_in_the_plan(spark):
    plan = spot.compare(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("the text").alias("text")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
