"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens until buckets are small.

A document is the set of its word shingles. In each of `runs` repetitions a set
follows every token t of its own with hash(path, t) < 1 / (threshold * size), so
that two sets at the threshold share 1/threshold * 2 * threshold / (1 + threshold)
tokens' choices on average if they are of one size, and 1 at least. Buckets of at
most `SMALL` sets are compared by brute force; larger ones are split again on
further tokens, `MAX_DEPTH` times at most, and what is left is compared in blocks.
Large buckets of which `ALIKE` or more have the same members hold sets that no
split parts: they are compared in blocks at once, as one. Similarities are exact.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.blocks import already, by_unit, links, pair_blocks
from patchloom.llm.common import components, cut, only, stash

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
SMALL = 64
MAX_DEPTH = 1
ALIKE = 4
SEED = 0x5DEECE66D
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before; emptied when it has grown to a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the n-word shingles; a text of fewer words has one, and a text without words none."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out + h[i : i + len(out)] + np.uint64(i + 1))
    return np.unique(out)


def chosen(tokens: np.ndarray, paths: np.ndarray, threshold: float) -> np.ndarray:
    """The paths a set follows from `paths`: at each, one for every token whose hash there falls under 1 / (threshold * size)."""
    h = mix(tokens[None, :] ^ mix(paths + np.uint64(SEED))[:, None])
    row, column = np.nonzero(h < np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(tokens))))))
    return np.unique(mix(h[row, column] + (paths[row] & np.uint64(0xFFFFFFFF)) + np.uint64(1))).view(np.int64)


def runs_for(threshold: float, recall: float, depth: int = MAX_DEPTH) -> int:
    """Repetitions after which a pair at the threshold has met with probability `recall`, though all its buckets were split `depth` times.

    Such a pair shares a token's choice with the probability 1 / (threshold * larger size).
    It shares `threshold` times the larger size of tokens where one set holds the other,
    more elsewhere, so the paths it goes on sharing are close to Poisson with the mean 1
    at every step, or more.
    """
    meet = 1.0
    for _ in range(depth + 1):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: key, class_id, n_links, kept.

    Two rows are linked if the Jaccard similarity of their sets of n-word
    shingles (lower-cased words between white space) is `threshold` or more;
    n_links counts a row's links, class_id is the smallest key reachable by
    links and kept says that this is its own. Null and empty texts, and texts of
    white space only, link with nothing. A text of fewer than n words has one
    shingle, the whole. Rows with equal sets are compared once and their links
    multiplied. Rows that repeat key and text count as one; a key with several
    texts takes the links of all. Rows with a null key are left out.
    """
    runs = runs_for(threshold, recall)
    docs = only(docs, key, text).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")

    def first_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        starts = mix(np.arange(1, runs + 1, dtype=np.uint64))
        for batch in batches:
            sets, sizes, paths = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t, n, hashes)
                sets.append(blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                sizes.append(len(s))
                paths.append(chosen(s, starts, threshold) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.string()), pa.array(sizes, pa.int32()), pa.array(paths, pa.list_(pa.int64()))], ["id", "cls", "size", "paths"])

    marked = stash(docs.mapInArrow(first_paths, "id long, cls string, size int, paths array<long>"))
    marked_ids = marked.select("id", "cls").distinct()
    classes = cut(marked_ids.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    # A row stands for its class; an id that stands for several classes does so once for each.
    lone = marked.select("id", "cls", "size", "paths").join(classes, "cls").filter("id = rep").dropDuplicates(["cls"])
    spots = lone.select(F.xxhash64("cls").alias("id"), "copies", "size", F.explode("paths").alias("path"))
    spots = cut(_met(spots, MAX_DEPTH == 0))

    wanted = cut(spots.select(F.col("id").alias("cid")).distinct())
    want_docs = wanted.join(classes.select(F.xxhash64("cls").alias("cid"), "cls", F.col("rep").alias("id")), "cid").select("cid", "cls", "id")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            kept = []
            for c, cls, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingles(t, n, hashes)
                # Rows that repeat key and text are in one task.
                if c not in seen and blake2b(s.tobytes(), digest_size=16).hexdigest() == cls:
                    seen.add(c)
                    kept.append((c, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.int64()), pa.array([s for _, s in kept], pa.binary())], ["cid", "tokens"])

    # Bucketed by set: no later join shuffles the tokens again.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = f"patchloom_sets_{uuid.uuid4().hex}"
    wanted_texts = docs.join(want_docs, "id").select("cid", "cls", "text").repartition(parts, "cid")
    try:
        wanted_texts.mapInArrow(sets_of, "cid long, tokens binary").write.bucketBy(parts, "cid").option("compression", "zstd").saveAsTable(name)
        found = _find(spots, docs.sparkSession.table(name), threshold)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    near = found.groupBy("id").agg(F.sum("n").alias("n"))
    by_class = classes.withColumn("id", F.xxhash64("cls"))
    edges = found.select(F.col("id").alias("src"), F.col("joined").alias("dst"))
    reps = by_class.select("id", "rep")
    edges = edges.join(reps.select(F.col("id").alias("src"), F.col("rep").alias("a")), "src").join(reps.select(F.col("id").alias("dst"), F.col("rep").alias("b")), "dst")
    joined = components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    told = by_class.join(near, "id", "left").drop("id").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    rows = marked_ids.join(told, "cls", "left").groupBy("id").agg(F.sum(F.coalesce(F.coalesce("n", F.lit(0)) + F.col("copies") - 1, F.lit(0))).alias("n_links"), F.min(F.coalesce("component", "rep", "id")).alias("class_id"))
    return rows.select(F.col("id").alias(key), "class_id", "n_links", (F.col("id") == F.col("class_id")).alias("kept"))


def _find(spots: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Splits large buckets on further tokens, level by level, and compares what is in the leaves."""
    leaves = []
    for depth in range(MAX_DEPTH + 1):
        leaves.append(spots.filter("leaf"))
        if depth == MAX_DEPTH:
            break
        large = spots.filter("not leaf").groupBy("id", "copies", "size").agg(F.collect_set("path").alias("paths"))
        if large.isEmpty():
            break

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                paths = []
                for tokens, at in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    s = np.frombuffer(tokens, dtype=np.uint64)
                    paths.append(chosen(s, np.array(at, dtype=np.int64).view(np.uint64), threshold))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(paths, pa.list_(pa.int64()))], ["id", "copies", "size", "paths"])

        deeper = large.join(sets.withColumnRenamed("cid", "id"), "id").select("id", "copies", "size", "tokens", "paths").mapInArrow(split, "id long, copies long, size int, paths array<long>")
        spots = cut(_met(deeper.select("id", "copies", "size", F.explode("paths").alias("path")), depth + 1 == MAX_DEPTH))

    return _verify(leaves, sets, threshold)


def _met(spots: DataFrame, last: bool) -> DataFrame:
    """The rows whose path holds several sets, with that number, and whether it is a leaf, to be compared and not split.

    Of leaves with the same members one stays. Paths still to be split all stay, as
    each is split by choices of its own and recall counts on every one.
    """
    paths = spots.groupBy("path").agg(F.count("*").alias("bucket_size"), F.bit_xor(F.xxhash64("id")).alias("a"), F.sum(F.shiftright(F.xxhash64("id", F.lit(1)), 24)).alias("b"))
    paths = paths.filter("bucket_size > 1").groupBy("bucket_size", "a", "b").agg(F.collect_list("path").alias("alike"))
    paths = paths.withColumn("leaf", F.lit(last) | (F.col("bucket_size") <= SMALL) | (F.size("alike") >= ALIKE))
    paths = paths.withColumn("path", F.explode(F.when(F.col("leaf"), F.array(F.array_min("alike"))).otherwise(F.col("alike"))))
    return spots.join(paths.select("path", "bucket_size", "leaf"), "path")


def _verify(leaves: list[DataFrame], sets: DataFrame, threshold: float) -> DataFrame:
    """Per block pair: id, n (links weighted by copies), joined."""
    spots = leaves[0]
    for more in leaves[1:]:
        spots = spots.unionByName(more)
    spots = spots.select("path", "id", "copies", "size", "bucket_size").dropDuplicates(["path", "id"])
    own = spots.groupBy("id").agg(F.collect_set("path").alias("kept"))
    # Sets of very different size cannot be similar: within a large bucket only neighbouring size classes meet.
    step = F.floor(F.log("size") / math.log(1 / threshold)).cast("int")
    small = spots.filter(F.col("bucket_size") <= SMALL).withColumn("part", F.xxhash64("path"))
    large = spots.filter(F.col("bucket_size") > SMALL).withColumn("step", F.explode(F.array(step, step + 1))).withColumn("part", F.xxhash64("path", "step"))
    large = large.withColumn("low", step == F.col("step"))
    sizes = large.groupBy("part").agg(F.count("*").alias("bucket_size"))
    large = large.drop("bucket_size").join(sizes, "part").filter("bucket_size > 1")
    cols = ["part", "path", "id", "copies", "size", "bucket_size", "low"]
    rows = small.withColumn("low", F.lit(True)).select(cols).unionByName(large.select(cols))
    work = pair_blocks(rows, "part", "id", "bucket_size").join(sets.withColumnRenamed("cid", "id").join(own, "id"), "id")

    def verify(rows: pa.Table) -> tuple[np.ndarray, ...] | None:
        n = rows.num_rows
        if n < 2:
            return None
        tokens = [np.frombuffer(t, dtype=np.uint64) for t in rows.column("tokens").to_pylist()]
        sizes = np.array([len(t) for t in tokens], dtype=np.float32)
        shared = common(tokens)
        linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
        linked &= exact(shared, sizes, threshold)
        low = rows.column("low").to_numpy(zero_copy_only=False)
        if not low.all():
            # Two sets of the upper class meet in that class's own part.
            linked &= low[:, None] | low[None, :]
        linked &= ~np.eye(n, dtype=bool)
        if not linked.any():
            return None
        before = already(rows.column("kept").combine_chunks(), rows.column("path")[0].as_py())
        if before is not None:
            linked &= ~before
        return links(rows.column("id").to_numpy(), rows.column("copies").to_numpy(), rows.column("side").to_numpy(), rows.column("alone")[0].as_py(), linked)

    found = by_unit(work.select("unit", "path", "id", "copies", "low", "side", "alone", "tokens", "kept"), verify, ["id", "n", "joined"], ["long"] * 3)
    return cut(found)


def common(tokens: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections: tokens in one set only take no part, the others are multiplied out `width` at a time."""
    n = len(tokens)
    flat = np.concatenate(tokens)
    row = np.repeat(np.arange(n), [len(t) for t in tokens])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    count = np.diff(np.r_[start, len(flat)])
    column = np.repeat(np.cumsum(count > 1) - 1, count)
    several = np.repeat(count > 1, count)
    row, column = row[several], column[several]
    out = np.zeros((n, n), dtype=np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, width):
        a, b = np.searchsorted(column, [at, at + width])
        held = np.zeros((n, min(width, total - at)), dtype=np.float32)
        held[row[a:b], column[a:b] - at] = 1
        out += held @ held.T
    return out


def exact(shared: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """shared / union >= threshold in double precision."""
    union = sizes[:, None].astype(np.float64) + sizes[None, :] - shared
    return shared.astype(np.float64) / np.maximum(union, 1) >= threshold


