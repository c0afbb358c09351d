"""Joins and reports over stacks, releases, sections and weekly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import text as tx


def asof(rows: DataFrame, marks: DataFrame, at: str, since: str, value: str) -> DataFrame:
    """rows with the value of the last mark at or before `at`; rows before the first mark are left out.

    Days hold both sides together; a mark of an earlier day is carried on by the last value of the days before.
    """
    last = marks.groupBy(F.to_date(since).alias("_day")).agg(F.max_by(value, since).alias("_last"))
    # One row a day, whatever the number of rows.
    days = rows.select(F.to_date(at).alias("_day")).unionByName(last.select("_day")).distinct().join(last, "_day", "left")
    carried = days.select("_day", F.last("_last", ignorenulls=True).over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    both = rows.withColumn("_day", F.to_date(at)).withColumn("_at", F.col(at)).withColumn("_mark", F.lit(False))
    more = marks.select(F.to_date(since).alias("_day"), F.col(since).alias("_at"), F.lit(True).alias("_mark"), value)
    mixed = both.unionByName(more, allowMissingColumns=True)
    seen = F.last(value, ignorenulls=True).over(Window.partitionBy("_day").orderBy("_at", F.desc("_mark")).rowsBetween(Window.unboundedPreceding, 0))
    found = mixed.withColumn("_seen", seen).filter("not _mark").drop(value).join(carried, "_day")
    return found.withColumn(value, F.coalesce("_seen", "_before")).filter(F.col(value).isNotNull()).select(*rows.columns, value)


def flow(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """invariant, dropped or new for every group of either stack."""
    a, b = before.withColumn("_a", F.lit(True)), after.withColumn("_b", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("_b").isNull(), "dropped").when(F.col("_a").isNull(), "new").otherwise("invariant").alias("flow"))


def durations(sides: DataFrame) -> DataFrame:
    g = sides.groupBy("cluster_id").agg(F.min("down").alias("a"), F.min("up").alias("b"), F.count("*").alias("num_up"))
    return g.select("cluster_id", F.to_date("a").alias("first_submission"), F.to_date("b").alias("integration"), "num_up", tx.floor_days(F.col("b"), F.col("a")).alias("dur"))


def composition(sides: DataFrame) -> DataFrame:
    """backport where the first upstream date is more than a day before the first downstream one, none without upstream."""
    g = sides.groupBy("cluster_id").agg(F.min("down").alias("down"), F.min("up").alias("up"))
    return g.select("cluster_id", F.when(F.col("up").isNull(), "none").when(tx.floor_days(F.col("up"), F.col("down")) < -1, "backport").otherwise("forwardport").alias("class"))


def section_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("section").agg(F.sum("lines").alias("lines"), F.count("*").alias("files"))


def section_graph(files: DataFrame) -> DataFrame:
    """(src, dst, lines, files): sections by the files they share; src = dst is the section's own weight."""
    a, b = files.alias("a"), files.alias("b")
    pairs = a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.section") <= F.col("b.section")))
    return pairs.groupBy(F.col("a.section").alias("src"), F.col("b.section").alias("dst")).agg(F.sum("a.lines").alias("lines"), F.count("*").alias("files"))


def occurrence(stacks: DataFrame) -> DataFrame:
    order = F.struct("day", "ord")
    return stacks.groupBy("grp").agg(F.min("ord").alias("oldest"), F.max("ord").alias("latest"), F.min_by("ord", order).alias("first_released"), F.max_by("ord", order).alias("last_released"))


def fill_weeks(every: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts by week and list with a row for each week between the first and the last, 0 where there is none."""
    span = every.agg(F.explode(F.sequence(F.min("week"), F.max("week"), F.expr("INTERVAL 7 DAY"))).alias("week"))
    # Weeks and lists are few, whatever the number of mails.
    grid = span.crossJoin(F.broadcast(every.select("list").distinct()))
    return grid.join(counts, ["week", "list"], "left").select("week", "list", F.coalesce("n", F.lit(0)).alias("n"))


def ecdf(rows: DataFrame, value: str) -> DataFrame:
    """Share of rows at or below each value; the running sum is over distinct values only."""
    n = rows.groupBy(value).agg(F.count("*").alias("n"))
    upto, total = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    return n.select(value, F.round(F.sum("n").over(upto) / F.sum("n").over(total), 6).alias("ecdf"))


def quantiles(rows: DataFrame, value: str, which: dict[str, float]) -> DataFrame:
    """One row with the named quantiles, interpolated between neighbours; values are counted first, so that what is sorted has no repetitions."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return n.select(F.col(value).cast("double").alias("v"), "n").agg(*[F.round(F.percentile("v", q, F.col("n")), 6).alias(name) for name, q in which.items()])


def within(rows: DataFrame, column: str, low: Column, high: Column, drop: dict[str, list]) -> DataFrame:
    """Rows strictly between two bounds, without the given values of other columns."""
    out = rows.filter((F.col(column) > low) & (F.col(column) < high))
    for name, values in drop.items():
        out = out.filter(F.col(name).isNull() | ~F.col(name).isin(values))
    return out


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows that the seed picks, the same ones for the same keys; every task hands on n rows at most."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def refresh(cached: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The cache with what is no longer wanted evicted and what is missing added."""
    kept = cached.join(wanted.select(key), key, "left_semi")
    return kept.unionByName(wanted.join(cached.select(key), key, "left_anti").select(*cached.columns))
