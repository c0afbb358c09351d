"""Shared helpers of the training-data operators: inputs, recovery points and connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HASH_BITS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset and all runs in one process (tests), a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="patchloom-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A recovery point: the rows are written to the shared checkpoint folder and the lineage ends there."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: For rows that are written and read once or twice, at half the time of the usual level.
LIGHT = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


def stash(df: DataFrame) -> DataFrame:
    """A recovery point for wide rows: written as lightly compressed Parquet in the shared folder and read back by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/patchloom-{uuid.uuid4().hex}"
    df.write.options(**LIGHT).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Deletes the files of a stash once no later plan reads it."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/patchloom-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def sweep(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written: it does so a moment after the driver has collected its garbage."""
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; further columns of the input, whatever their names, do not take part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def crc_of_id(name: str) -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (src, dst) as (node, component), component the smallest node.

    Alternating large-star and small-star contraction: each round is two
    aggregated joins over the edges, and rounds grow with the logarithm of the
    longest path. Nodes without an edge do not appear. Edges with a null end and
    loops carry no information and are skipped; repeated edges count once.
    """
    e = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    e = cut(e.filter("src is not null and dst is not null and src <> dst").distinct())
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.join(low, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = large.filter("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src")
        small = small.select("src", F.col("low").alias("dst")).unionByName(
            small.filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        )
        e = cut(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )
