"""Packing along a space-filling curve: hashed document vectors, Hilbert order, gapless sequences.

Each token id has a fixed random direction; a document's vector is the mean over
its ids, `DIMS` numbers. These are spread over 2 ** LEVELS steps each, and the
Hilbert index of the cell is the sort key. Along that order the documents are
laid end to end and cut at multiples of the sequence length, so that only the
very last sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.common import cut, only, stash
from patchloom.llm.word_bpe import word_ids

LENGTH = 4096
END = 2
DIMS = 4
LEVELS = 8
SEED = 97


def directions(ids: int = 1 << 16, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(ids, dims)).astype(np.float32)


def means(ids: bytes, table: np.ndarray) -> np.ndarray:
    """The mean of the directions of little-endian 16-bit ids."""
    return np.einsum("ij->j", table.take(np.frombuffer(ids, dtype="<u2"), axis=0)) / (len(ids) // 2)


def hilbert(cells: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Hilbert indices of the rows of cells, whose values have `levels` bits each.

    Each level looks at one bit of every dimension and reflects or swaps the
    lower bits, so that neighbouring indices are neighbouring cells.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(levels - 1, 0, -1):
        q, below = 1 << level, (1 << level) - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(hit, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap if i else 0
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(levels - 1, 0, -1):
        q = 1 << level
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(levels - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level & 1)
    return key


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Null texts count as empty and give the end id alone; texts are encoded whole.
    Equal texts lie next to each other, ordered by key; repeated rows are packed
    each. A document longer than what is left of a sequence goes on in the next.
    An empty table gives no pieces.
    """
    names = [f"v{i}" for i in range(DIMS)]
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = word_ids(vocabulary, end), directions()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = list(words.encode_all(part.column(1).to_pylist()))
                v = np.stack([means(b, table) for b in ids]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) // 2 for b in ids], pa.int64()), pa.array(ids, pa.binary()), *map(pa.array, v.T)], [key, "n", "ids", *names])

    encoded = only(docs, key, text).mapInArrow(encode, f"`{key}` {kind}, n long, ids binary, " + ", ".join(f"{c} double" for c in names))
    encoded = stash(encoded.withColumn("uid", F.monotonically_increasing_id()))
    moments = encoded.agg(*[f(c) for c in names for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([m or 0.0 for m in moments[0::2]])
    scale = np.array([s or 1.0 for s in moments[1::2]])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.stack([batch.column(i).to_numpy() for i in range(3, 3 + DIMS)], axis=1)
            z = np.clip((v - mean) / scale, -30, 30)
            cells = np.minimum((1 << LEVELS) - 1, ((1 << LEVELS) / (1 + np.exp(-1.702 * z))).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(hilbert(cells))], [key, "uid", "n", "curve"])

    light = encoded.select(key, "uid", "n", *names).mapInArrow(order, f"`{key}` {kind}, uid long, n long, curve long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = ["curve", key, "uid"]
    ranged = cut(light.repartitionByRange(parts, *sort).withColumn("part", F.spark_partition_id()))
    # One row per range partition: a bounded table for the sums before each.
    before = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    before = before.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    within = Window.partitionBy("part").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("n").over(within)).join(F.broadcast(before), "part")
    placed = placed.select("uid", (F.col("base") + F.col("upto") - F.col("n")).alias("place"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            keys: list[int] = []
            for i, (ids, place) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                n, start = len(ids) // 2, 0
                while start < n:
                    spot = (place + start) % length
                    size = min(n - start, length - spot)
                    piece = np.frombuffer(ids, dtype="<u2", count=size, offset=2 * start).astype("<u4")
                    rows.append((start, size, zlib.crc32(piece.tobytes()), n, (place + start) // length, spot, piece.astype(np.int32) if with_ids else None))
                    keys.append(i)
                    start += size
            if rows:
                cols = list(zip(*rows, strict=True))
                ids = [pa.array(cols[6], pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), *(pa.array(c, pa.int64()) for c in cols[:6]), *ids], [key, *out, *["ids"] * with_ids])

    out = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = encoded.select("uid", key, "ids").join(placed, "uid").select(key, "ids", "place")
    return pieces.mapInArrow(cut_up, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in out) + ", ids array<int>" * with_ids)
