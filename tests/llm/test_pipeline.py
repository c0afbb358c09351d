"""The stages of the corpus pipeline against brute force, each on the rows its predecessor kept."""

import random
from collections import Counter
from itertools import combinations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from patchloom.llm import fuzzy_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts() -> dict[int, str]:
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(60) for _ in range(4)]
    out = {}
    for i in range(160):
        lines = [line(rng.randint(25, 40)) for _ in range(rng.randint(1, 3))]
        if i % 4 == 1:
            words = rng.choice(shared).split()
            if i % 8 == 1:
                words[rng.randrange(60)] += "s"
            lines.insert(rng.randint(0, len(lines)), "  ".join(words).upper())
        if i % 3 == 0:
            lines[0] = "you utter scum and vile filth " + lines[0]
        out[i] = "\n".join(lines)
    base = line(80).split()
    for i in range(160, 166):
        # Near copies of a whole text whose lines break elsewhere, so that line dedup leaves them.
        at = 20 + 7 * (i - 160)
        out[i] = " ".join(base[:at]) + "\n" + " ".join(base[at:])
    return out


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _groups(items: list, linked) -> dict:
    """The smallest index of the connected group of every item."""
    group = list(range(len(items)))
    for a, b in combinations(range(len(items)), 2):
        if group[a] != group[b] and linked(items[a], items[b]):
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    return dict(zip(items, group, strict=True))


def _without_lines(texts: dict[int, str]) -> dict[int, str]:
    norm = lambda x: " ".join(x.lower().split())
    distinct = sorted({norm(x) for t in texts.values() for x in t.split("\n")} - {""})
    letters = {x: Counter(x) for x in distinct}

    def linked(a, b):
        most = int(max(len(a), len(b)) * 0.1 + 1e-9)
        # Letters that only one of them has must be put in or taken out.
        if max((letters[a] - letters[b]).total(), (letters[b] - letters[a]).total()) > most:
            return False
        return _distance(a, b) <= most

    group, seen, out = _groups(distinct, linked), set(), {}
    for i in sorted(texts):
        left = []
        for x in texts[i].split("\n"):
            g = group.get(norm(x))
            if g is None or g not in seen:
                left.append(x)
            seen.add(g)
        if left:
            out[i] = "\n".join(left)
    return out


def _one_of_each(texts: dict[int, str]) -> set[int]:
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    ids = sorted(texts)
    group = _groups(ids, lambda a, b: bool(sets[a] | sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    return {ids[g] for g in group.values()}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    sf, texts = str(tmp_path_factory.mktemp("sf")), _texts()
    spark.createDataFrame([(i, 1, int(i % 3 == 0 and i < 160)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    out = [docs.collect()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/stage{n}")
        docs = spark.read.parquet(f"{sf}/stage{n}")
        out.append(docs.collect())
    return out


def _by_id(rows) -> dict[int, str]:
    return {r.doc_id: r.text for r in rows}


def test_toxic_documents_go(steps):
    before, after = _by_id(steps[0]), _by_id(steps[1])
    clean = {i for i in before if i % 3 or i >= 160}
    assert len(clean & set(after)) >= 0.97 * len(clean) and len(set(after) - clean) <= 0.03 * len(before)
    assert all(after[i] == before[i] for i in after)


def test_repeated_lines_go(steps):
    got = _by_id(steps[2])
    assert got == _without_lines(_by_id(steps[1])) and got != _by_id(steps[1])
    assert all(r.n_chars == len(r.text) for r in steps[2])


def test_one_document_of_each_group_stays(steps):
    before, after = _by_id(steps[2]), _by_id(steps[3])
    assert set(after) == _one_of_each(before) and len(after) < len(before) and all(after[i] == before[i] for i in after)


def test_all_that_is_left_is_packed(steps):
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(ids.encode(t, add_special_tokens=False).ids) + 1 for i, t in _by_id(steps[3]).items()}
    got = {}
    for r in steps[4]:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_pairs_are_verified_by_the_edit_rule(spark):
    """The words that settle most pairs give the answer of the edit distance; the aligned words an upper bound of it."""
    rng, rows = random.Random(3), []
    for i in range(400):
        a = ["".join(rng.choice("abcé\U0001f600") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at, kind = rng.randrange(len(b)), rng.randrange(3)
            if kind == 0:
                b[at] = rng.choice(["ab", "é", b[at][:-1] + "c"])
            elif kind == 1:
                b.insert(at, "abc"[: rng.randint(1, 3)])
            elif len(b) > 1:
                b.pop(at)
        if a != b:
            rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    texts = spark.createDataFrame(rows, "k long, norm string").withColumn("chars", F.length("norm"))
    pairs = texts.filter("k % 2 = 0").select(F.col("k").alias("src"), (F.col("k") + 1).alias("dst"))
    got = {r.src for r in fuzzy_lines.similar(pairs, texts).collect()}
    line = dict(rows)
    want = {k for k in line if k % 2 == 0 and _distance(line[k], line[k + 1]) <= int(max(len(line[k]), len(line[k + 1])) * 0.1 + 1e-9)}
    assert got == want and 50 < len(want) < len(line) / 2 - 50
    few = F.when(F.size("a") <= F.size("b"), F.col("a")).otherwise(F.col("b"))
    more = F.when(F.size("a") <= F.size("b"), F.col("b")).otherwise(F.col("a"))
    words = spark.createDataFrame([(k, line[k].split(" "), line[k + 1].split(" "), _distance(line[k], line[k + 1])) for k in line if k % 2 == 0], "k long, a array<string>, b array<string>, d int")
    assert words.filter(fuzzy_lines._aligned(few, more, F.abs(F.size("a") - F.size("b"))) < F.col("d")).count() == 0


def test_rows_without_id_stay(spark):
    rows = [(None, "a text without an id that is like no other", "en", "s", 42), (1, "some other text of more than five words", "en", "s", 39), (2, "some other text of more than five words", "en", "s", 39)]
    got = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id is None, r.text) for r in got) == [(False, rows[1][1]), (True, rows[0][1])]
