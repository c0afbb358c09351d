"""Mailbox files to raw mails, split by the text reader, so that one large file is read by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What parts mails in a mailbox.
DELIMITER = "\nFrom "


def _mails(lines: DataFrame) -> DataFrame:
    # By bytes, as mails need not be UTF-8; what comes before the first newline is the From line.
    whole = F.expr("substring(cast(value AS binary), octet_length(substring_index(value, '\\n', 1)) + 2)")
    return lines.select(whole.alias("raw")).filter("length(raw) > 0").withColumn("md5", F.md5("raw"))


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """raw, md5: every different mail once, without its From line."""
    return _mails(spark.read.option("lineSep", DELIMITER).text(path)).dropDuplicates(["md5"])


def stream_mbox(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of mailbox files that arrive in a folder; mails seen before are left out."""
    return _mails(spark.readStream.option("lineSep", DELIMITER).text(path)).dropDuplicates(["md5"])


def sync_mbox(spark: SparkSession, path: str, store: str, checkpoint: str) -> StreamingQuery:
    """Brings a store of mails up to date with the mailbox files of a folder; a run takes what arrived since the last one.

    The store, not the stream, knows which mails it has, so that nothing is kept in memory
    however long it goes on: each batch is joined against the hashes of the store, which lie in folders by their first
    digits. A batch writes one folder of the store, named by its number and left out when it is looked up, so that a batch
    that is run again after a failure gives what it would have given.
    """

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["md5"]).withColumn("part", F.substring("md5", 1, 2))
        known = stored(batch.sparkSession, store)
        if known is not None:
            fresh = fresh.join(known.filter(F.col("batch") != number).select("part", "md5"), ["part", "md5"], "left_anti")
        fresh.select("raw", "md5", "part").write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={number}")

    mails = _mails(spark.readStream.option("lineSep", DELIMITER).text(path))
    return mails.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """raw, md5, batch, part of a store's mails; None where nothing was stored yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema("raw binary, md5 string, batch long, part string").parquet(store)


def read_maildir(spark: SparkSession, path: str) -> DataFrame:
    """raw, md5: every different file below a folder, one mail each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("content").alias("raw"), F.md5("content").alias("md5")).dropDuplicates(["md5"])
