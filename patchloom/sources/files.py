"""Text files of the engine: hash lists, mail indexes, clusterings, false positives, stacks, section tables, configuration."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.operators.clusters import components

#: Columns of a patch stack definition, a fixed format.
STACK_COLUMNS = ["BaseCommit", "BaseVersion", "BaseReleaseDate", "Branch", "StackVersion", "StackReleaseDate"]
GENERAL_SECTION = "THE REST"


def whole_or_split(spark: SparkSession, path: str) -> str:
    """The path of a text if it is there, else that of all parts it was split to (`path.000`, ...)."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm)
    return path if there is not None and len(there) else f"{path}.[0-9][0-9][0-9]"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a text in ISO 8859-1, parts of a split file one after another; pos grows along the text. A file that is not split goes before parts of its name."""
    rows = spark.read.format("binaryFile").load(whole_or_split(spark, path)).select(F.col("_metadata.file_name").alias("file"), F.decode("content", "iso-8859-1").alias("text"))
    lines = rows.select("file", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    return lines.select(F.struct("file", "n").alias("pos"), "line")


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(pos, hash): lines that are not blank and no comment, in their order."""
    return read_lines(spark, path).select("pos", F.trim("line").alias("hash")).filter("hash <> '' and not startswith(hash, '#')")


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV that was cut to parts, of which only the first has the header; all columns as text."""
    path = whole_or_split(spark, path)
    files = [r.f for r in spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("f")).distinct().orderBy("f").collect()]
    head = spark.read.option("header", True).csv(files[:1])
    names = head.columns
    schema = ", ".join(f"`{c}` string" for c in names)
    return head if len(files) < 2 else head.unionByName(spark.read.schema(schema).csv(files[1:]))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(day, id, location) of lines `YYYY/MM/DD id location`; further fields are left out."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = read_lines(spark, path).select(parts.alias("p")).filter("size(p) >= 3")
    return rows.select(F.to_date(F.col("p")[0], "yyyy/MM/dd").alias("day"), F.col("p")[1].alias("id"), F.col("p")[2].alias("location"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(id, cluster_id, is_upstream) of lines `d1 d2 => u1 u2`; lines that share an id are one cluster, named by its smallest id."""
    lines = read_lines(spark, path).filter("trim(line) <> ''")
    sides = F.split("line", "=>")
    ids = lambda side: F.filter(F.split(F.trim(side), r"\s+"), lambda x: x != "")
    up = F.when(F.size(sides) > 1, ids(sides[1])).otherwise(F.array().cast("array<string>"))
    rows = lines.select(ids(sides[0]).alias("down"), up.alias("up")).withColumn("head", F.array_min(F.concat("down", "up")))
    told = rows.select("head", F.explode(F.concat(F.transform("down", lambda x: F.struct(x.alias("id"), F.lit(False).alias("u"))), F.transform("up", lambda x: F.struct(x.alias("id"), F.lit(True).alias("u"))))).alias("m"))
    members = told.select("head", F.col("m.id").alias("id"), F.col("m.u").alias("u"))
    groups = components(members.select(F.col("head").alias("a"), F.col("id").alias("b")), members.select("id"))
    return members.groupBy("id").agg(F.bool_or("u").alias("is_upstream")).join(groups, "id").select("id", "cluster_id", "is_upstream")


def read_false_positives(spark: SparkSession, path: str) -> DataFrame:
    """(origin, dest) of lines `origin dest1 dest2`; a file that is not there gives no rows."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], "origin string, dest string")
    parts = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    rows = read_lines(spark, path).select(parts.alias("p")).filter("size(p) > 1")
    return rows.select(F.col("p")[0].alias("origin"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("dest")).distinct()


def false_positive_file(mode: str, upstream: bool) -> str:
    """The file of false positives for a mode, mbox or patchstack."""
    return ("mbox-" if mode == "mbox" else "") + ("upstream" if upstream else "patch-stack")


def read_stacks(spark: SparkSession, path: str) -> DataFrame:
    """(ord, grp, base_commit, ..., stack_date) of a stack definition: `## group` lines, `#` comments, a header, then rows.

    A definition has as many rows as there are stacks, so it is read by the driver.
    """
    group, rows, seen = None, [], False
    for r in read_lines(spark, path).orderBy("pos").collect():
        line = r.line.strip()
        if line.startswith("## "):
            group = line[3:].strip()
        elif line and not line.startswith("#"):
            cells = [c.strip('"') for c in line.split()]
            if not seen:
                if cells != STACK_COLUMNS:
                    raise ValueError(f"{path}: the header must be {' '.join(STACK_COLUMNS)}")
                seen = True
                continue
            if len(cells) != len(STACK_COLUMNS):
                raise ValueError(f"{path}: {line}")
            rows.append((len(rows), group, *cells))
    out = spark.createDataFrame(rows, "ord int, grp string, base_commit string, base_version string, base_date string, branch string, stack_version string, stack_date string")
    return out.withColumn("base_date", F.to_date("base_date")).withColumn("stack_date", F.to_date("stack_date"))


def read_section_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(representative, section, size) of a table of section clusters."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col("c_representative").alias("representative"), F.col("c_section").alias("section"), F.col("c_size").cast("long").alias("size"))


def read_section_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, lines, size) of a table of section edges, without the section that holds everything and without loops."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(F.col("`from`").alias("src"), F.col("to").alias("dst"), F.col("lines").cast("long").alias("lines"), F.col("size").cast("long").alias("size"))
    return rows.filter((F.col("src") != GENERAL_SECTION) & (F.col("dst") != GENERAL_SECTION) & (F.col("src") != F.col("dst")))


def refresh_upstream(spark: SparkSession, path: str, revisions: str, fresh: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """(pos, hash) of upstream commits from a cache whose first line names the revision range; of `fresh` where that is another.

    Hashes on the blacklist are left out either way.
    """
    cached = read_lines(spark, path) if path else None
    first = cached.orderBy("pos").first() if cached is not None else None
    rows = cached.filter(F.col("pos") > F.struct(F.lit(first.pos.file).alias("file"), F.lit(first.pos.n).alias("n"))).select("pos", F.trim("line").alias("hash")).filter("hash <> ''") if first and first.line.strip() == revisions else fresh
    return rows if blacklist is None else rows.join(blacklist.select("hash"), "hash", "left_anti").select("pos", "hash")


def merged(base: dict, over: dict) -> dict:
    """base with the entries of over; tables in both are merged in turn."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


@dataclass(frozen=True)
class Thresholds:
    """Ratings from `accept` on are accepted, below `ask` declined; an interval of 0 days is no bound."""

    accept: float = 0.85
    ask: float = 0.8
    lines_ratio: float = 0.4
    heading: float = 0.65
    filename: float = 0.9
    weight: float = 0.3
    interval: int = 0

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if v < 0 or f.name != "interval" and v > 1:
                raise ValueError(f"{f.name} = {v} is out of range")


@dataclass(frozen=True)
class Config:
    mode: str
    project: str
    base: str
    entries: dict = field(hash=False, default_factory=dict)
    thresholds: Thresholds = field(default_factory=Thresholds)

    def path(self, name: str) -> str:
        """The path of an entry, from the configuration's folder on unless it is absolute."""
        return str(PurePosixPath(self.base) / self.entries[name])


def read_config(spark: SparkSession, path: str, default: str | None = None) -> Config:
    """A project's TOML over the default one; files are read by Spark, so they may lie in any store."""
    def load(p: str) -> dict:
        return tomllib.loads(spark.read.text(p, wholetext=True).first().value)

    top = merged(load(default) if default else {}, load(path))
    if top.get("MODE") not in ("mbox", "patchstack"):
        raise ValueError(f"{path}: MODE must be mbox or patchstack")
    known = {f.name for f in fields(Thresholds)}
    given = {k: v for k, v in top.get("thresholds", {}).items() if k in known}
    return Config(top["MODE"], top.get("PROJECT", ""), path.rsplit("/", 1)[0], top, Thresholds(**given))
