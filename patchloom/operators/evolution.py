"""Reports on how patch stacks evolve: counts, sizes, what became of patches, and the tables that are exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import text as tx


def select_date(kind: str, release: Column, commit: Column, author: Column) -> Column:
    """The date that counts for a commit: SRD its stack's release, CD that of the commit, AD that of its author."""
    return {"SRD": release, "CD": commit, "AD": author}[kind]


def commit_counts(patches: DataFrame, releases: DataFrame) -> DataFrame:
    """(grp, version, date, n): commits of each stack (patches: version) that has a release (grp, version, date)."""
    return patches.groupBy("version").agg(F.count("*").alias("n")).join(releases, "version").select("grp", "version", "date", "n")


def diffstat(changes: DataFrame, releases: DataFrame) -> DataFrame:
    """(grp, version, date, insertions, deletions, total) from lines changed by file (version, insertions, deletions)."""
    s = changes.groupBy("version").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    return s.join(releases, "version").select("grp", "version", "date", "insertions", "deletions", (F.col("insertions") + F.col("deletions")).alias("total"))


def branch_observation(patches: DataFrame, releases: DataFrame, upstream: DataFrame) -> DataFrame:
    """(grp, version, type, n): the patches (patch_group, version) of each stack by what became of their group (patch_group, type), invariant if nothing."""
    rows = patches.join(releases.select("grp", "version"), "version", "left").join(upstream.select("patch_group", "type"), "patch_group", "left")
    return rows.groupBy("grp", "version", F.coalesce("type", F.lit("invariant")).alias("type")).agg(F.count("*").alias("n"))


def stack_future(patches: DataFrame, occurrence: DataFrame, releases: DataFrame, upstream: DataFrame) -> DataFrame:
    """(grp, version, type, n): as `branch_observation`, where invariant patches of groups that no later stack holds are dropped ones.

    occurrence: (patch_group, latest) with the ordinal of the last stack; releases: (grp, version, date, ord).
    """
    newest = releases.agg(F.max("ord").alias("newest"))
    rows = patches.join(releases.select("grp", "version"), "version", "left").join(upstream.select("patch_group", "type"), "patch_group", "left").join(occurrence.select("patch_group", "latest"), "patch_group", "left")
    kind = F.when(F.col("type").isNotNull(), F.col("type")).when(F.col("latest") < F.col("newest"), "dropped").otherwise("invariant")
    return rows.crossJoin(F.broadcast(newest)).groupBy("grp", "version", kind.alias("type")).agg(F.count("*").alias("n"))


def group_bounds(releases: DataFrame) -> DataFrame:
    """(grp, first_version, last_version, first_date, last_date) of each version group by the order of its stacks."""
    first, last = F.min_by("version", "ord"), F.max_by("version", "ord")
    return releases.groupBy("grp").agg(first.alias("first_version"), last.alias("last_version"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def release_dates(releases: DataFrame) -> DataFrame:
    """(version, date), one row a version: the date of the last stack that names it."""
    return releases.groupBy("version").agg(F.max_by("date", "ord").alias("date"))


def release_order(releases: DataFrame) -> DataFrame:
    """(grp, version, pos): versions in the order of their stacks, each where it first occurs."""
    first = releases.groupBy("grp", "version").agg(F.min("ord").alias("ord"))
    return first.select("grp", "version", F.row_number().over(Window.orderBy("ord", "version")).alias("pos"))


def upstream_table(members: DataFrame, dates: DataFrame, first_seen: DataFrame) -> DataFrame:
    """(patch_group, upstream_hash, commit_date, first_occurrence, days, type) of groups that came upstream, by their first commit.

    members: (id, cluster_id, is_upstream); dates: (id, ts) of commits; first_seen: (cluster_id, ts) of the first stack with the group.
    """
    up = members.filter("is_upstream").join(dates, "id").groupBy("cluster_id").agg(F.min(F.struct("ts", "id")).alias("m"))
    rows = up.join(first_seen.withColumnRenamed("ts", "seen"), "cluster_id").select(F.col("cluster_id").alias("patch_group"), F.col("m.id").alias("upstream_hash"), F.col("m.ts").alias("ts"), "seen")
    days = tx.floor_days(F.col("ts"), F.col("seen"))
    return rows.select("patch_group", "upstream_hash", F.to_date("ts").alias("commit_date"), F.to_date("seen").alias("first_occurrence"), days.alias("days"), F.when(days < -1, "backport").otherwise("forwardport").alias("type"))


def descriptions(commits: DataFrame, stacks: DataFrame, tags: DataFrame) -> DataFrame:
    """(commit, branch, author_date, commit_date, release_date): the stack of a commit and its release, or master and the first tag after the commit.

    commits: (commit, author_date, commit_date); stacks: (commit, stack_version, release_date), of several the last row by date; tags: (ts).
    """
    own = stacks.groupBy("commit").agg(F.max(F.struct("release_date", "stack_version")).alias("s"))
    rows = commits.join(own, "commit", "left")
    plain = rows.filter("s is null").select("commit", F.col("commit_date").alias("at"))
    marks = tags.select(F.col("ts").alias("at"), F.lit(None).cast("string").alias("commit"), F.col("ts").alias("tag"))
    # The next tag at or after a commit: months hold both sides, a month's first tag is carried back over months without one.
    mixed = plain.select("at", F.col("commit").cast("string").alias("commit"), F.lit(None).cast("timestamp").alias("tag")).unionByName(marks.select(F.col("at"), "commit", F.col("tag").cast("timestamp").alias("tag"))).withColumn("month", F.trunc("at", "month"))
    firsts = mixed.groupBy("month").agg(F.min("tag").alias("first"))
    later = firsts.select("month", F.first("first", ignorenulls=True).over(Window.orderBy("month").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    # Read backwards: a frame that only grows is summed up once, one that shrinks anew for every row.
    here = F.last("tag", ignorenulls=True).over(Window.partitionBy("month").orderBy(F.desc("at"), F.col("tag").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    next_ = mixed.withColumn("here", here).filter("commit is not null").join(later, "month").select("commit", F.coalesce("here", "later").alias("next"))
    out = rows.withColumn("_c", F.col("commit").cast("string")).join(next_.withColumnRenamed("commit", "_c").dropDuplicates(["_c"]), "_c", "left")
    return out.select("commit", F.coalesce("s.stack_version", F.lit("master")).alias("branch"), "author_date", "commit_date", F.to_date(F.coalesce("s.release_date", "next")).alias("release_date"))


def with_mails(commits: DataFrame, members: DataFrame, mails: DataFrame, dates: DataFrame | None = None, forward_only: bool = False) -> DataFrame:
    """(id, found): whether a cluster of the commit holds a mail, and with `forward_only` one that was sent before the commit was made.

    commits: (id); mails: (id); dates: (id, ts) of both.
    """
    c = commits.join(members.select("id", "cluster_id"), "id").select(F.col("id").alias("commit"), "cluster_id")
    m = mails.join(members.select("id", "cluster_id"), "id").select(F.col("id").alias("mail"), "cluster_id")
    if forward_only:
        first = m.join(dates.select(F.col("id").alias("mail"), "ts"), "mail").groupBy("cluster_id").agg(F.min("ts").alias("sent"))
        hit = c.join(dates.select(F.col("id").alias("commit"), "ts"), "commit").join(first, "cluster_id").filter(tx.floor_days(F.col("ts"), F.col("sent")) >= -1)
    else:
        hit = c.join(m.select("cluster_id").distinct(), "cluster_id", "left_semi")
    known = hit.select(F.col("commit").alias("id")).distinct().withColumn("found", F.lit(True))
    return commits.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))
