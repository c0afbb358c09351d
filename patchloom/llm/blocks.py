"""Brute force inside small buckets, spread over tasks as block pairs.

A bucket is cut into blocks of at most `BLOCK` members; every pair of blocks is
one unit of work. Pairs are never emitted: a unit returns, per member, how many
links it has there and the smallest member it is joined to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
#: Columns that are multiplied out at a time.
WIDTH = 4096


def pair_blocks(members: DataFrame, bucket: str, member: str, size: str, block: int = BLOCK) -> DataFrame:
    """Rows (unit, left_side, right_side, ...) that put every pair of a bucket's members into exactly one unit.

    Members are dealt to ceil(size / block) blocks by a hash, so that no task gets a whole large bucket.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64(member), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    return (
        members.withColumn("_n", n)
        .withColumn("_mine", mine)
        .withColumn("_other", other)
        .withColumn("unit", F.xxhash64(bucket, F.least("_mine", "_other"), F.greatest("_mine", "_other")))
        .withColumn("side", (F.col("_mine") > F.col("_other")).cast("int"))
        .withColumn("alone", F.col("_mine") == F.col("_other"))
        .drop("_n", "_mine", "_other")
    )


def reps(adjacent: np.ndarray) -> np.ndarray:
    """For every row of a symmetric boolean matrix the smallest index of its connected part."""
    n = len(adjacent)
    label = np.arange(n)
    while True:
        best = np.minimum(label, np.where(adjacent, label[None, :], n).min(axis=1, initial=n))
        best = best[best]
        if np.array_equal(best, label):
            return label
        label = best


def links(ids: np.ndarray, weight: np.ndarray, side: np.ndarray, alone: bool, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, the summed weights of the members linked here, and the smallest id each is joined to, for members with a link."""
    linked = linked & ~np.eye(len(ids), dtype=bool)
    if not alone:
        linked &= side[:, None] != side[None, :]
    count = linked @ weight
    touched = linked.any(axis=1)
    order = np.argsort(ids, kind="stable")
    label = reps(linked[np.ix_(order, order)])
    joined = np.empty_like(ids)
    joined[order] = ids[order][label]
    return ids[touched], count[touched], joined[touched]


def already(lists: pa.ListArray, at: int) -> np.ndarray | None:
    """Which pairs of rows share a value below `at`; None where none does. The lists of a row hold no value twice."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    low = flat < at
    values, column, count = np.unique(flat[low], return_inverse=True, return_counts=True)
    shared = count[column] > 1
    if not shared.any():
        return None
    # A value that few rows share marks their pairs directly; the others are multiplied out, some columns at a time.
    place = np.cumsum(count > 1) - 1
    row, column = row[low][shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(lists), len(lists)), dtype=np.float32)
    total = int(column[-1]) + 1
    for at in range(0, total, WIDTH):
        a, b = np.searchsorted(column, [at, at + WIDTH])
        held = np.zeros((len(lists), min(WIDTH, total - at)), dtype=np.float32)
        held[row[a:b], column[a:b] - at] = 1
        out += held @ held.T
    return out > 0


def by_unit(work: DataFrame, verify: Callable[[pa.Table], tuple[np.ndarray, ...] | None], names: list[str], kinds: list[str]) -> DataFrame:
    """Applies `verify` to the rows of each unit; many small units share one call into Python, and one unit is in memory at a time."""
    types = {"long": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def checked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            unit = rows.column("unit").to_numpy()
            edges = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
            found = [x for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if (x := verify(rows.slice(a, b - a))) is not None]
            if found:
                cols = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column("unit").to_numpy()
            last = int(np.searchsorted(unit, unit[-1]))
            if last or (rest and rest[0].column("unit")[0].as_py() != unit[0]):
                head = [*rest, batch.slice(0, last)] if last else rest
                yield from checked(pa.Table.from_batches(head).combine_chunks())
                rest = []
            rest.append(batch.slice(last))
        if rest:
            yield from checked(pa.Table.from_batches(rest).combine_chunks())

    dealt = work.repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
