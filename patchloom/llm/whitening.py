"""Whitening of embeddings by a covariance in two passes over their distinct vectors.

Entries become whole numbers, so that the first pass, plain sums, is exact. The
second sums outer products of centred rows, one matrix product a batch, and a
tree of tasks merges the matrices. The driver holds one matrix of dimension by
dimension, whatever the number of rows; its eigenvectors are broadcast, and the
rows are projected where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import cut, only

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries whose multiple by SCALE lies this far from nought have no whole number of 64 bits.
HUGE = float((1 << 63) - (1 << 20))
#: Above this sum of squares, well beyond what 64 bits hold, its approximation alone tells that they do not.
BEYOND = 1.5 * 2.0**63
#: Rows that numpy works on at a time.
BATCH = 4096
#: Tasks of a tree's last level send their matrices to the driver.
DEPTH = 2


def whole_numbers(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): the vectors in whole numbers; those that are null, or hold entries that are null or not finite, are left out."""
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * SCALE) < HUGE))
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return only(rows, key, vector).filter(F.col(vector).isNotNull() & fine).select(key, x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _pieces(batches: Iterator[pa.RecordBatch], at: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches in pieces of bounded size, each with its vectors as rows of a matrix."""
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH):
            batch = whole.slice(start, BATCH)
            yield batch, _matrix(batch.column(at), d)


def _centred(x: np.ndarray, base: np.ndarray, part: np.ndarray) -> np.ndarray:
    """x less its mean base + part; whole numbers are subtracted as such, in halves, so that nothing is lost however large they are."""
    high, low = (x >> 32) - (base >> 32), (x & 0xFFFFFFFF) - (base & 0xFFFFFFFF)
    return high * 2.0**32 + low - part


def _squares(x: np.ndarray, n: int, base: np.ndarray, rest: np.ndarray) -> pa.Array:
    """For every row the sum of (n * x - s)^2, where s = n * base + rest, exactly; null where 64 bits do not hold it.

    Whole numbers that outgrow 64 bits keep their lowest ones, so the sum is right
    wherever it fits, and floating point tells where it does not.
    """
    apart = (x - base) * np.int64(n) - rest
    exact = (apart * apart).sum(axis=1)
    about = ((n * _centred(x, base, rest / n)) ** 2).sum(axis=1)
    return pa.array(exact, mask=(about > BEYOND) | (exact < 0))


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, x in _pieces(batches, 0, d):
            n += len(x)
            # In halves, as sums of a piece may outgrow 64 bits.
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (a << 32) + b for t, a, b in zip(total, high, low, strict=True)]
        if n:
            # Sums of a task may outgrow 64 bits.
            yield pa.RecordBatch.from_arrays([pa.array([n] * d, pa.int64()), pa.array(range(d), pa.int32()), pa.array([str(t) for t in total])], ["n", "i", "s"])

    parts = fit.mapInArrow(run, "n long, i int, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = parts.orderBy("i").collect()
    return (int(rows[0]["n"]), [int(r["s"]) for r in rows]) if rows else (0, [])


Moments = tuple[int, np.ndarray, np.ndarray]


def _merge(a: Moments | None, b: Moments | None) -> Moments | None:
    """Count, mean and centred products of both parts together."""
    if a is None or b is None:
        return b if a is None else a
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _moments(fit: DataFrame, d: int, image) -> Moments | None:  # noqa: ANN001
    """Count, mean and sum of centred outer products of image(x) over all vectors, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Moments | None = None
        for _, x in _pieces(batches, 0, d):
            y = image(x)
            mean = y.mean(axis=0)
            y = y - mean
            total = _merge(total, (len(y), mean, y.T @ y))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), pa.array([total[1].tobytes()]), pa.array([total[2].tobytes()])], ["n", "mean", "products"])

    def add(total: Moments | None, row) -> Moments:  # noqa: ANN001
        mean = np.frombuffer(row["mean"])
        return _merge(total, (row["n"], mean, np.frombuffer(row["products"]).reshape(len(mean), len(mean))))

    return fit.mapInArrow(run, "n long, mean binary, products binary").rdd.treeAggregate(None, add, _merge, DEPTH)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: key, component, n, deviation, whitened, explained, identity_error, squares.

    Vectors that are null, or hold null or non-finite entries, are left out, and
    so are those of another length than most have (of equally many, the longer),
    and entries of about 2^57 and more, whose whole number has no 64 bits, count as not finite. Rows that repeat are kept,
    but the distinct whole-number vectors alone make up the mean and the
    covariance, each once. Components without variance (an eigenvalue below what
    rounding leaves of nought) have explained 0 and no whitened value; so has a
    table of one distinct vector. Fewer dimensions than components give as many
    as there are. An empty table gives no rows.

    n is the number of distinct vectors, deviation the exact sum over dimensions
    of n * x less the sum of x, squares the exact sum over dimensions of the square of that (null where
    64 bits do not hold it), identity_error the largest absolute entry of the
    whitened values' covariance less the identity, measured by a pass of its own.
    """
    x = whole_numbers(rows, key, vector)
    spark, kind = rows.sparkSession, dict(x.dtypes)[key]
    out = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, squares long"
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).filter("d > 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], out)
    d = lengths[0]["d"]
    x = x.filter(F.size("x") == d)
    fit = cut(x.select("x").distinct())
    n, s = _sums(fit, d)
    base = np.array([t // n for t in s], dtype=np.int64)
    part = np.array([t % n / n for t in s])
    _, _, products = _moments(fit, d, lambda v: _centred(v, base, part))
    values, vectors = np.linalg.eigh(products / n)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    e, w, trace = values[order], vectors[:, order], float(np.trace(products / n))
    real = e > max(trace, 0.0) * d * np.finfo(float).eps
    sent = spark.sparkContext.broadcast((base, part, w[:, real] / np.sqrt(e[real])))

    def project(v: np.ndarray) -> np.ndarray:
        base, part, to = sent.value
        return _centred(v, base, part) @ to

    error = 0.0
    if real.any():
        count, _, cov = _moments(fit, d, project)
        error = float(np.abs(cov / count - np.eye(int(real.sum()))).max())
    explained = np.where(real, e / trace if trace > 0 else 0.0, 0.0)
    left, places = np.array([t % n for t in s], dtype=np.int64), np.flatnonzero(real)
    k = len(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v in _pieces(batches, 1, d):
            m = len(v)
            whitened = np.full((m, k), np.nan)
            whitened[:, places] = project(v)
            # n * x - s by dimension is n * (x - base) less what the division left.
            deviation = n * (v - sent.value[0]).sum(axis=1) - left.sum()
            squares = _squares(v, n, sent.value[0], left)
            each = pa.array(np.repeat(np.arange(m), k))
            flat = pa.array(whitened.ravel(), mask=np.tile(~real, m))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)), pa.array(np.repeat(deviation, k)), flat, pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)), squares.take(each)],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error", "squares"],
            )

    return x.select(key, "x").mapInArrow(run, out)
