"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

A vector is rotated by three rounds of random signs and a Hadamard transform;
its hash is the signed axis it lies nearest to. `depth` hashes make a bucket key
and `tables` keys a vector. A vector also enters the buckets of its second-best
axes (multiprobe). Pairs that meet are verified by cosine in double precision.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.blocks import already, by_unit, links, pair_blocks
from patchloom.llm.common import components, cut, only, stash

THRESHOLD = 0.95
PROBES = 2
MISSED = 1e-5
SEED = 20240611
ROUNDS = 3
#: Vectors of one bucket that are compared in one task.
BUCKET_TARGET = 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        pairs = x.reshape(len(x), -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / math.sqrt(n)


def axes(x: np.ndarray, seed: list[int], probes: int) -> np.ndarray:
    """For each row the `probes` nearest signed axes after the rotation that the seed names."""
    rng = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        x = hadamard(x * rng.choice([-1.0, 1.0], size=x.shape[1]))
    top = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :probes]
    return 2 * top + (np.take_along_axis(x, top, axis=1) > 0)


def plan(rows: int, dim: int, threshold: float, probes: int = PROBES, missed: float = MISSED) -> tuple[int, int]:
    """(depth, tables): buckets stay small as rows grow, and a pair at the threshold is missed with probability `missed` at most."""
    wide = 1 << max(1, (dim - 1).bit_length())
    depth = max(1, math.ceil(math.log(max(rows / BUCKET_TARGET, 2)) / math.log(2 * wide)))
    rng = np.random.default_rng(SEED)
    a, b = rng.normal(size=(2, 4000, wide))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b
    x, y = axes(a, [SEED], probes), axes(c, [SEED], probes)
    meet = min(0.999, float((x[:, :, None] == y[:, None, :]).any((1, 2)).mean()) - 0.02) ** depth
    return depth, max(1, math.ceil(math.log(missed) / math.log1p(-meet)))


def keys(x: np.ndarray, depth: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """Bucket keys as (rows, tables * probes ** depth) unsigned 64-bit integers; a key names its table."""
    wide = 1 << max(1, (x.shape[1] - 1).bit_length())
    full = np.zeros((len(x), wide))
    full[:, : x.shape[1]] = x
    out = []
    for t in range(tables):
        near = [axes(full, [SEED, t, d], probes).astype(np.uint64) for d in range(depth)]
        for choice in itertools.product(range(probes), repeat=depth):
            key = np.full(len(x), t + 1, dtype=np.uint64)
            for d, c in enumerate(choice):
                key = key * np.uint64(0x9E3779B97F4A7C15) + near[d][:, c] + np.uint64(1)
                key ^= key >> np.uint64(29)
            out.append(key)
    return np.stack(out, axis=1) if out else np.zeros((len(x), 0), dtype=np.uint64)


def unit_rows(lists: list[list | None], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one in double precision, and which lists can have one: not null, not zero, all components finite."""
    x = np.zeros((len(lists), dim))
    ok = np.zeros(len(lists), dtype=bool)
    for i, v in enumerate(lists):
        if v and not any(c is None for c in v):
            x[i, : len(v)] = v
            ok[i] = np.isfinite(x[i]).all() and bool(np.any(x[i]))
    x[~ok] = 0
    scale = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = np.divide(x, scale, out=x, where=scale > 0)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=x, where=norm > 0), ok


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    n_links counts the other rows whose cosine is `threshold` or more;
    component_id is the smallest key reachable by links. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. Vectors
    of different lengths are compared as if the shorter went on with zeros. Equal
    vectors are compared once and their links multiplied. Rows that repeat a key
    and a vector count as one; a key with several vectors takes the links of all.
    """
    spark = df.sparkSession
    base = only(df, key, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).distinct()
    classed = stash(base.withColumn("cls", F.md5(F.coalesce(F.col("v").cast("string"), F.lit("")).cast("binary"))))
    groups = classed.groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    lone = stash(classed.join(groups, "cls").filter("id = rep").select("rep", "copies", "v").dropDuplicates(["rep", "v"]))
    shape = lone.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(shape[1] or 1, 1)
    depth, tables = plan(shape[0], width, threshold)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = unit_rows(batch.column(2).to_pylist(), width)
            found = keys(x[ok], depth, tables).view(np.int64)
            rows = pa.array([r.tobytes() for r in x[ok]], pa.binary())
            lists = pa.array([np.unique(r) for r in found], pa.list_(pa.int64()))
            kept = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), rows, lists], ["id", "copies", "x", "keys"])

    hashed = stash(lone.select("rep", "copies", "v").mapInArrow(hash_rows, "id long, copies long, x binary, keys array<long>"))
    spots = hashed.select("id", F.explode("keys").alias("key"))
    # Buckets with the same members do the same work: the one with the smallest key stays.
    buckets = spots.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("a"), F.sum(F.shiftright(F.xxhash64("id", F.lit(1)), 24)).alias("b"))
    buckets = buckets.filter("size > 1").groupBy("size", "a", "b").agg(F.min("key").alias("key")).select("key", "size")
    where = cut(spots.join(buckets, "key"))
    own = where.groupBy("id").agg(F.collect_set("key").alias("kept"))
    units = pair_blocks(where, "key", "id", "size").join(hashed.select("id", "copies", "x").join(own, "id"), "id")

    def verify(rows: pa.Table) -> tuple[np.ndarray, ...] | None:
        n = rows.num_rows
        x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype=np.float64).reshape(n, -1)
        linked = x @ x.T >= threshold
        if linked.sum() <= n:
            return None
        # A pair counts in the first bucket that holds both.
        before = already(rows.column("kept").combine_chunks(), rows.column("key")[0].as_py())
        if before is not None:
            linked &= ~before
        sides = rows.column("side").to_numpy()
        return links(rows.column("id").to_numpy(), rows.column("copies").to_numpy(), sides, rows.column("alone")[0].as_py(), linked)

    found = cut(by_unit(units.select("unit", "key", "id", "copies", "x", "kept", "side", "alone"), verify, ["id", "n", "joined"], ["long"] * 3))
    near = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("id").alias("src"), F.col("joined").alias("dst")))
    per_rep = groups.join(near.withColumnRenamed("id", "rep"), "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    usable = F.col("v").isNotNull() & F.exists("v", lambda c: c != 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = classed.join(per_rep, "cls").select(
        "id",
        F.when(usable, F.coalesce("n", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("n_links"),
        F.when(usable, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component_id"),
    )
    rows = rows.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return rows.select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
