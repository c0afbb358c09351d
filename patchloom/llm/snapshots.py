"""Chat formatting over cumulative logs: conversations that are a prefix of a longer one are collapsed, the rest rendered.

Every turn gets four 32-bit hashes of its place, role and text; running sums of
them along a conversation are the rolling hash of each turn prefix (128 bits).
A conversation whose whole hash is a proper prefix hash of another is a
snapshot of it and is anti-joined away. Only hashes travel until then; texts are
joined once, for the conversations that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.common import only

SEEDS = (17, 29)
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"
MASK = 0xFFFFFFFF


def _lanes(place: Column) -> list[Column]:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashes = [F.xxhash64(F.lit(s), place, role, text) for s in SEEDS]
    return [lane.bitwiseAND(F.lit(MASK).cast("long")) for h in hashes for lane in (h, F.shiftrightunsigned(h, 32))]


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, snapshots: the maximal conversations, and how many logged ones each stands for with itself.

    Of equal conversations the one with the smallest conv_id stays. A snapshot of
    several maximal conversations counts for the one with the smallest conv_id.
    """
    base = only(turns, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = base.withColumn("place", F.row_number().over(order))
    lanes = numbered.select("conv_id", "place", *[c.alias(f"h{i}") for i, c in enumerate(_lanes(F.col("place")))])
    along = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("conv_id").orderBy("place")
    prefix = lanes.select(
        "conv_id", "place", F.md5(F.concat_ws(",", "place", *[F.sum(f"h{i}").over(along).cast("string") for i in range(4)]).cast("binary")).alias("key"),
        F.lead("place").over(ahead).isNull().alias("last"),
    )
    whole = prefix.filter("last").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("place").alias("n_turns"), F.count("*").alias("copies"))
    longer = prefix.filter("not last").select("conv_id", "key")
    # A prefix that very many conversations share is one row before it meets anything.
    kept = whole.join(longer.select("key").distinct(), "key", "left_anti")
    counted = longer.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("key").agg(F.min("conv_id").alias("conv_id")).join(whole.select("key", "copies"), "key")
    extra = counted.groupBy("conv_id").agg(F.sum("copies").alias("more"))
    return kept.join(extra, "conv_id", "left").select("conv_id", "n_turns", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("snapshots"))


def render(turns: DataFrame) -> DataFrame:
    """One row per turn of the maximal conversations: conv_id, turn_index, role, rendered, char_start, trained, n_turns, snapshots.

    `rendered` texts of a conversation, in the order of turn_index, make up its
    training sample; char_start is where each begins there and `trained` marks
    what the model answers for. A sample stays one row per turn, so that no
    conversation, however long, has to fit into one row. Turns are ordered by
    turn, nulls first, then role and text; repeated rows stay repeated. Null
    roles and texts count as empty. Rows without conv_id belong to no
    conversation and are left out.
    """
    base = only(turns, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    rows = base.join(collapse(turns), "conv_id")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rendered = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    rows = rows.withColumn("turn_index", F.row_number().over(order) - 1).withColumn("rendered", rendered)
    before = Window.partitionBy("conv_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)).cast("long")
    return rows.select("conv_id", "turn_index", "role", "rendered", start.alias("char_start"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("trained"), "n_turns", "snapshots")


#: Conversations as arrays of (role, text); prefixes are compared as text.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, place, role, text,
         string_agg(length(coalesce(role, '')) || ':' || coalesce(role, '') || length(coalesce(text, '')) || ':' || coalesce(text, ''), '') OVER (PARTITION BY conv_id ORDER BY place) AS pre,
         max(place) OVER (PARTITION BY conv_id) AS n
  FROM t),
w AS (SELECT pre, min(conv_id) AS conv_id, min(n) AS n_turns, count(*) AS copies FROM p WHERE place = n GROUP BY pre),
k AS (SELECT * FROM w WHERE pre NOT IN (SELECT pre FROM p WHERE place < n)),
x AS (
  SELECT conv_id, sum(copies) AS more FROM (
    SELECT min(p.conv_id) AS conv_id, max(w.copies) AS copies
    FROM p JOIN w ON p.pre = w.pre JOIN k ON p.conv_id = k.conv_id WHERE p.place < p.n GROUP BY p.pre)
  GROUP BY conv_id),
r AS (
  SELECT p.conv_id, p.place, p.role, '<|' || coalesce(p.role, '') || '|>' || chr(10) || coalesce(p.text, '') || chr(10) || '<|end|>' || chr(10) AS rendered,
         k.n_turns, k.copies + coalesce(x.more, 0) AS snapshots
  FROM p JOIN k ON p.conv_id = k.conv_id LEFT JOIN x ON x.conv_id = k.conv_id)
SELECT conv_id, CAST(place - 1 AS INTEGER) AS turn_index, role, rendered,
       CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
       coalesce(role = 'assistant', false) AS trained, CAST(n_turns AS INTEGER) AS n_turns, CAST(snapshots AS BIGINT) AS snapshots
FROM r
"""
