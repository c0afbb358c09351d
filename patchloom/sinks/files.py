"""Text and CSV files that other tools read: every writer takes DataFrames and a path, and writes with Spark.

A file whose lines have an order is written by range-sorted tasks: its part files,
read in the order of their names, are the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No part file has more bytes than this, unless a single line has: 50 MiB.
LIMIT = 50 * 1024 * 1024


def _lines(rows: DataFrame, line: Column, order: list[Column | str], path: str, limit: int = LIMIT) -> None:
    """Sorted lines in part files that are cut between lines: as many lines a file as fit if all were as long as the longest."""
    longest = rows.select(F.max(F.octet_length(line)).alias("n")).first()["n"] or 0
    rows.orderBy(*order).select(line.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", max(1, limit // (longest + 1))).text(path)


def cluster_lines(members: DataFrame) -> DataFrame:
    """One row per cluster: line (`d1 d2 => u1 u2`), down, up; members (id, cluster_id, is_upstream) in order, each once.

    Clusters of downstream members alone have no `=>`, those of upstream members
    alone begin with it.
    """
    rows = members.filter("id is not null").groupBy("cluster_id").agg(
        F.array_sort(F.collect_set(F.when(~F.col("is_upstream"), F.col("id").cast("string")))).alias("down"),
        F.array_sort(F.collect_set(F.when(F.col("is_upstream"), F.col("id").cast("string")))).alias("up"),
    )
    down, up = F.array_join("down", " "), F.array_join("up", " ")
    line = F.when(F.size("up") == 0, down).when(F.size("down") == 0, F.concat(F.lit("=> "), up)).otherwise(F.concat(down, F.lit(" => "), up))
    return rows.select(line.alias("line"), "down", "up")


def write_clusters(members: DataFrame, path: str) -> None:
    """Clusters in the order of their downstream, then upstream members; those without downstream members come last."""
    _lines(cluster_lines(members), F.col("line"), [F.size("down") == 0, "down", "up"], path)


def write_index(mails: DataFrame, path: str) -> None:
    """Lines `YYYY/MM/DD id location` from (day, id, location), sorted."""
    line = F.concat_ws(" ", F.date_format("day", "yyyy/MM/dd"), "id", "location")
    _lines(mails, line, [line], path)


def invalidate(invalid: DataFrame, more: DataFrame) -> DataFrame:
    """Ids known to be invalid with further ones, each once."""
    return invalid.select("id").unionByName(more.select("id")).distinct()


def write_hashes(hashes: DataFrame, path: str, order: str | None = None) -> None:
    """One hash a line, in the order of a column or, without one, sorted."""
    _lines(hashes, F.col("hash"), [order or "hash"], path)


def write_ratings(ratings: DataFrame, path: str) -> None:
    """Candidates of every original from the best down, as Parquet sorted within files."""
    ratings.repartition("orig").sortWithinPartitions("orig", F.desc(F.col("msg") + F.col("diff")), "cand").write.mode("overwrite").parquet(path)


def write_false_positives(pairs: DataFrame, path: str) -> None:
    """Lines `origin dest1 dest2` from (origin, dest), all sorted."""
    rows = pairs.groupBy("origin").agg(F.array_sort(F.collect_set("dest")).alias("dests"))
    _lines(rows, F.concat_ws(" ", "origin", F.array_join("dests", " ")), ["origin"], path)


def write_csv(rows: DataFrame, path: str, order: list[str] | None = None, sep: str = ",") -> None:
    """A table with a header line, sorted if asked for; NULL is an empty field, booleans are True and False."""
    cols = [F.initcap(F.col(f"`{c}`").cast("string")).alias(c) if t == "boolean" else F.col(f"`{c}`") for c, t in rows.dtypes]
    shaped = rows.select(*cols)
    (shaped.orderBy(*order) if order else shaped).write.mode("overwrite").option("header", True).option("sep", sep).option("emptyValue", "").csv(path)


def characteristics_table(mails: DataFrame) -> DataFrame:
    """The 13 columns of a mail on a list, one row per mail and list."""
    return mails.select(
        "id", "from", "time", "type", "version", F.explode_outer("lists").alias("list"), "matches", "ignored", "commithash", "committer", "correct", "xcorrect", "distance"
    ).select(
        "id", "from", "time", "type", "version", "list",
        F.when(F.col("matches").isNotNull(), F.array_contains("matches", F.col("list"))).alias("list.matches_patch"),
        "ignored", "commithash", "committer", F.col("correct").alias("committer.correct"), F.col("xcorrect").alias("committer.xcorrect"), F.col("distance").alias("committer.distance"),
    )


def releases_table(tags: DataFrame, start: Column, end: Column) -> DataFrame:
    """(release, date) of the tags (tag, ts) after start and before end, release candidates left out."""
    return tags.filter((F.col("ts") > start) & (F.col("ts") < end) & ~F.col("tag").contains("-rc")).select(F.col("tag").alias("release"), F.to_date("ts").alias("date"))


def off_list_table(commits: DataFrame) -> DataFrame:
    return commits.select("commit", "author", "committer", "subject", F.col("n_down").cast("int").alias("l_down"), F.to_date("author_date").alias("adate"), F.to_date("commit_date").alias("cdate"))


def write_metrics(scores: DataFrame, path: str) -> None:
    """Lines `name: value` with three decimals, from a table of one row."""
    cells = F.array(*[F.concat(F.lit(f"{c}: "), F.format_string("%.3f", F.col(c).cast("double"))) for c in scores.columns])
    scores.limit(1).select(F.posexplode(cells).alias("pos", "value")).orderBy("pos").select("value").coalesce(1).write.mode("overwrite").text(path)


def reviews_table(patches: DataFrame, responses: DataFrame) -> DataFrame:
    """(cluster_id, patch_id, upstream, responses): what was answered to every patch of a cluster, oldest answers first.

    patches: (cluster_id, patch_id, is_upstream); responses: (patch_id, resp_msg_id, parent, message, position).
    """
    up = patches.filter("is_upstream").groupBy("cluster_id").agg(F.array_sort(F.collect_set("patch_id")).alias("upstream"))
    told = responses.groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct("position", "resp_msg_id", "parent", "message"))).alias("r"))
    rows = patches.filter(~F.col("is_upstream")).select("cluster_id", "patch_id").join(up, "cluster_id", "left").join(told, "patch_id", "left")
    slim = F.transform("r", lambda x: F.struct(x["resp_msg_id"].alias("resp_msg_id"), x["parent"].alias("parent"), x["message"].alias("message")))
    return rows.select("cluster_id", "patch_id", F.coalesce("upstream", F.array().cast("array<string>")).alias("upstream"), F.coalesce(slim, F.array()).alias("responses"))
