"""Sets of tables that statistics read: patch groups over stacks, and sections with their files, each set made from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.operators import evolution as ev
from patchloom.operators import reports as rp
from patchloom.operators import sections as se
from patchloom.sinks.files import write_csv


def patch_group_tables(members: DataFrame, stacks: DataFrame, commits: DataFrame) -> dict[str, DataFrame]:
    """`patches`, `occurrence`, `upstream` of all patch groups that have a commit in a stack.

    members: (id, cluster_id, is_upstream); stacks: (commit, version, base, ord, day), ord the place of the
    stack and day the date that counts for the commit; commits: (id, ts). A commit that several stacks hold counts for the last of them.
    Of equal days the earlier stack is the first and the later one the last.
    """
    own = stacks.groupBy("commit").agg(F.max(F.struct("ord", "version", "base", "day")).alias("s"))
    down = members.filter(~F.col("is_upstream")).select(F.col("id").alias("commit"), F.col("cluster_id").alias("patch_group")).join(own, "commit").select("patch_group", "commit", "s.*")
    version = lambda best, *order: best("version", F.struct(*order))
    occurrence = down.groupBy("patch_group").agg(
        version(F.min_by, "ord", "version").alias("oldest_version"), version(F.max_by, "ord", "version").alias("latest_version"),
        version(F.min_by, "day", "ord", "version").alias("first_released_in"), version(F.max_by, "day", "ord", "version").alias("last_released_in"),
    )
    seen = down.groupBy(F.col("patch_group").alias("cluster_id")).agg(F.min("day").cast("timestamp").alias("ts"))
    return {
        "patches": down.select("patch_group", F.col("commit").alias("commit_hash"), F.col("version").alias("stack_version"), F.col("base").alias("base_version")),
        "occurrence": occurrence,
        "upstream": ev.upstream_table(members, commits, seen).select("patch_group", "upstream_hash", "commit_date", "first_occurrence"),
    }


def release_tables(stacks: DataFrame) -> dict[str, DataFrame]:
    """`mainline_releases`, `stack_releases`, `release_order` of stack definitions (grp, version, base, ord, date, base_date)."""
    return {
        "mainline_releases": ev.release_dates(stacks.select(F.col("base").alias("version"), F.col("base_date").alias("date"), "ord")),
        "stack_releases": stacks.groupBy("version").agg(F.max(F.struct("ord", "grp", "date")).alias("s")).select(F.col("s.grp").alias("grp"), "version", F.col("s.date").alias("date")),
        "release_order": ev.release_order(stacks.select("grp", "version", "ord")),
    }


def section_tables(files: DataFrame, sections: DataFrame, selected: DataFrame) -> dict[str, DataFrame]:
    """`sections`, `files`, `graph`: sizes of all sections with their status, the sections of every file, and the graph between sections.

    files: (file, section, lines), a row for each section of a file; sections: (section, status), those
    without a file too; selected: (file) of a filter, whose share of each section's lines is told. A file counts once a section.
    """
    rows = files.select("file", "section", "lines").distinct().join(selected.select("file").distinct().withColumn("hit", F.lit(True)), "file", "left")
    hit = F.coalesce("hit", F.lit(False))
    size = rows.groupBy("section").agg(
        F.count("*").alias("n_files"), F.sum("lines").alias("lines"), F.count_if(hit).alias("n_files_in_filter"), F.sum(F.when(hit, F.col("lines")).otherwise(0)).alias("lines_in_filter")
    )
    zero = ["n_files", "lines", "n_files_in_filter", "lines_in_filter"]
    report = sections.select("section", "status").join(size, "section", "left").fillna(0, zero)
    share = F.when(F.col("lines") > 0, F.col("lines_in_filter") / F.col("lines"))
    return {
        "sections": report.select("section", "status", *[F.col(c).cast("long").alias(c) for c in zero], share.alias("share")),
        "files": rows.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set(F.col("section").cast("string"))), "|").alias("sections"), F.max("lines").alias("lines")),
        "graph": se.with_lonely(rp.section_graph(rows.select("file", "section", "lines")), sections.select("section")),
    }


def write_tables(tables: dict[str, DataFrame], folder: str, sep: str = ",") -> None:
    """Every table as CSV with a header in a folder of its name, in the order of its columns."""
    for name, rows in tables.items():
        write_csv(rows, f"{folder}/{name}", rows.columns, sep)
