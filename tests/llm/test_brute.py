"""Operators without SQL against plain Python: FTRL weights, hashes of packed ids, the pipeline's stages on empty and null texts."""

import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from patchloom.llm import hilbert_pack, toxicity

BPE = public_tokenizers.path("word_bpe_49k.json")
ODD, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _features(text, bits):
    """Numbers of words, bigrams and skip-grams in whole-number arithmetic; 0 is the bias."""
    h = [(zlib.crc32(w.encode()) << 32 | zlib.adler32(w.encode())) * ODD & ALL for w in re.findall(r"\w+", (text or "").lower())]
    mixed = list(h)
    for gap in (1, 2, 3):
        mixed += [((a * ODD & ALL) + b + min(gap, 2) & ALL) * ODD & ALL for a, b in zip(h, h[gap:], strict=False)]
    return {0} | {max(((x ^ x >> 32) * ODD & ALL) >> 64 - bits, 1) for x in mixed}


def _ftrl(rows, bits, epochs=3, alpha=1.0, beta=1.0, l1=6.0, l2=0.1):
    """One coordinate after the other, as the method is written down."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= (l1 if i else 0.0):
            return 0.0
        return -(z[i] - math.copysign(l1 if i else 0.0, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for at, y in rows:
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for i in at:
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - step * w[i], n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i))}


def test_weights_equal_plain_ftrl(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["scum", "été", "日本"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30)) + ["scum idiot"] * (i % 3 == 0)) for i in range(150)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(152)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels)
    assert {r.text for r in rows.collect()} == {t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 4 != 2}
    order = sorted(rows.collect(), key=lambda r: (r.turn, r.text is not None, (r.text or "").encode()))
    for bits in (12, toxicity.BITS):
        got = toxicity.fit(rows, bits)
        want = _ftrl([(_features(r.text, bits), r.label) for r in order], bits)
        assert set(got) == set(want) and got == pytest.approx(want, rel=1e-9) and len(got) > 5
    scored = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    for i, t in enumerate(texts):
        s = 1 / (1 + math.exp(-sum(want.get(f, 0.0) for f in _features(t, toxicity.BITS))))
        assert scored[i].score == pytest.approx(s, rel=1e-9) and scored[i].predicted == (s >= 0.3) and scored[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_pieces_hold_the_ids_of_the_tokenizer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tok = Tokenizer.from_file(str(Path(BPE)))
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    got = hilbert_pack.pack(docs, BPE, with_ids=False).collect()
    for r in got:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert len(piece) == r.length > 0 and r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in got) == sum(map(len, ids.values()))


@pytest.mark.parametrize("texts", [[], [None], [None, "", None], ["one and the same line of words", None, "one and the same line of words"]])
def test_stages_on_empty_and_null_texts(spark, texts, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            kept = [r.text for r in docs.orderBy("doc_id").collect()]
            # What repeats goes with the line dedup, rows without text stay.
            assert kept == (texts if name == "toxicity" else [t for i, t in enumerate(texts) if t is None or t not in texts[:i]])
    assert docs.filter("length > 0").select("doc_id").distinct().count() == len(kept)
