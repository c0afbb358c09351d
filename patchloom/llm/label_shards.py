"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents are linked if their texts are equal; each is linked to its group, not
to every copy. They start in shards dealt by hash. In every round a group's
documents ask for the shard where most of the group's bytes lie, and of what a
shard is asked for, it takes the share that its capacity allows. At the end,
linked documents above a shard's even share and all documents without links,
which have no neighbours to lose, are laid out in order and fill the shards to
the same number of bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.common import cut, only

SHARDS = 24
ROUNDS = 4
#: How far above its even share a shard may be filled while labels move.
SLACK = 1.0
#: Buckets of a running sum: their totals are one small table, each bucket is sorted by itself.
BUCKETS = 1024
SPLIT = 256


def _uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) that the columns decide."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / float(1 << 53)


def running(df: DataFrame, buckets: list[str], order: list[str], value: Column | str, name: str, within: str | None = None) -> DataFrame:
    """Adds the sum of `value` before each row, in the order of buckets and then `order`, from zero anew for each `within`.

    No task sorts more than one bucket; the totals of the buckets are summed by themselves.
    """
    df = df.withColumn("_value", F.col(value) if isinstance(value, str) else value)
    totals = df.groupBy(*buckets).agg(F.sum("_value").alias("_total"))
    over = (Window.partitionBy(within) if within else Window.partitionBy()).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(over), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*buckets).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_before", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    keys = reduce(lambda a, b: a & b, [F.col(f"p.{b}") == F.col(f"t.{b}") for b in buckets])
    joined = placed.alias("p").join(totals.alias("t"), keys)
    return joined.select("p.*", (F.col("p._before") + F.col("t._base")).alias(name)).drop("_value", "_before")


def _by_shard(values: dict[int, float], default: float, of: str) -> Column:
    """values[of] as an expression; there is one entry per shard."""
    out = F.lit(float(default))
    for k, v in values.items():
        out = F.when(F.col(of) == k, F.lit(float(v))).otherwise(out)
    return out


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: all shards hold the same bytes but for less than one
    document each. size is the text's UTF-8 bytes plus 8 (a null text has none and
    is equal to an empty one). slot counts from 0 in every shard. Rows that repeat
    are documents of their own with equal texts. A group larger than a shard is
    cut over as few shards as hold it. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = only(docs, key, text).select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(body).alias("g1"), F.xxhash64(F.lit(1), body).alias("g2"), F.monotonically_increasing_id().alias("uid"),
    )
    # The ids are made from a scan, so they are cut from its plan before anything depends on them.
    base = cut(base)
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    even = total / n
    groups = base.groupBy("g1", "g2").agg(F.count("*").alias("copies"), F.sum("size").alias("group_size"))
    groups = cut(groups)
    linked = base.join(groups.filter("copies > 1"), ["g1", "g2"]).withColumn("at", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(n)).cast("int"))
    linked = cut(linked)
    # A group that fits easily moves as one; a large one moves document by document, as far as there is room.
    whole = F.col("group_size") * 4 <= even

    for turn in range(rounds):
        votes = linked.groupBy("g1", "g2", "at").agg(F.sum("size").alias("votes"))
        top = votes.groupBy("g1", "g2").agg(F.max(F.struct("votes", (-F.col("at")).alias("low"))).alias("best"))
        # One row a group, cut off so that the documents of a large group can be spread over tasks where they meet it.
        top = cut(top.select("g1", "g2", (-F.col("best.low")).alias("wish")))
        asking = linked.join(top, ["g1", "g2"])
        flows = asking.groupBy("at", "wish").agg(F.sum("size").alias("bytes")).collect()
        load = dict.fromkeys(range(n), 0.0)
        into, out = dict(load), dict(load)
        for f in flows:
            load[f["at"]] += f["bytes"]
            if f["at"] != f["wish"]:
                into[f["wish"]] += f["bytes"]
                out[f["at"]] += f["bytes"]
        share = {s: max(0.0, min(1.0, (even * SLACK - load[s] + out[s]) / into[s])) if into[s] else 0.0 for s in range(n)}
        chance = F.when(whole, _uniform(F.lit(turn), "g1", "g2")).otherwise(_uniform(F.lit(turn), "doc_id", "uid"))
        moved = asking.withColumn("at", F.when((F.col("wish") != F.col("at")) & (chance < _by_shard(share, 0.0, "wish")), F.col("wish")).otherwise(F.col("at")))
        linked = cut(moved.drop("wish"))

    # What a shard holds of linked documents up to its even share stays; groups stay in one piece.
    linked = linked.withColumn("range", F.shiftrightunsigned("g1", 54).cast("int")).withColumn("sub", F.when(whole, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "uid"), F.lit(SPLIT))).cast("int"))
    linked = running(linked, ["at", "range", "sub"], ["g1", "g2", "doc_id", "uid"], "size", "upto", within="at")
    # Documents of a large group that are left behind in shards where little of it lies go where there is room for them together.
    here = linked.filter(~whole).groupBy("g1", "g2", "at").agg(F.sum("size").alias("here"))
    linked = linked.join(here, ["g1", "g2", "at"], "left")
    linked = cut(linked.withColumn("stays", (F.col("upto") + F.col("size") <= even) & (F.coalesce("here", F.lit(even)) * 2 >= even)))
    held = {r["at"]: r["bytes"] for r in linked.filter("stays").groupBy("at").agg(F.sum("size").alias("bytes")).collect()}
    alone = base.join(groups.filter("copies = 1"), ["g1", "g2"]).withColumn("at", F.lit(n)).withColumn("range", F.shiftrightunsigned("g1", 54).cast("int")).withColumn("sub", F.lit(-1))
    cols = ["doc_id", "uid", "size", "text_crc32", "g1", "g2", "at", "range", "sub"]
    pool = linked.filter("not stays").withColumn("at", F.lit(-1)).select(cols).unionByName(alone.select(cols))
    pool = running(pool, ["at", "range", "sub"], ["g1", "g2", "doc_id", "uid"], "size", "upto")
    middle, end, target = F.col("upto") + F.col("size") / 2, 0.0, F.lit(n - 1)
    for s in range(n):
        end += even - held.get(s, 0)
        target = target - F.when(middle < end, 1).otherwise(0) if s < n - 1 else target
    pool = pool.withColumn("shard", F.greatest(target, F.lit(0)).cast("int"))
    done = linked.filter("stays").select("doc_id", "uid", "size", "text_crc32", F.col("at").alias("shard")).unionByName(pool.select("doc_id", "uid", "size", "text_crc32", "shard"))
    done = done.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(BUCKETS)).cast("int"))
    done = running(done, ["shard", "bucket"], ["doc_id", "uid"], F.lit(1), "slot", within="shard")
    return done.select(F.col("doc_id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
