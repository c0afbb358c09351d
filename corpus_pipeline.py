"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import chosen_path, fuzzy_lines, hilbert_pack, toxicity
from patchloom.llm.common import drop_stash, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it is fitted on the labels of the rows at hand."""
    scored = toxicity.classify(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.filter("predicted = 0").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur before; those left without any line go."""
    kept = fuzzy_lines.dedup(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more connect: that of the smallest doc_id. Rows without a doc_id take no part and stay."""
    kept = chosen_path.join(docs).filter("kept").select("doc_id")
    rows = docs.select(*COLUMNS)
    return rows.join(kept, "doc_id", "left_semi").select(*COLUMNS).unionByName(rows.filter("doc_id is null"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of 4096 tokens."""
    return hilbert_pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [("toxicity", without_toxic), ("line dedup", without_repeated_lines), ("n-gram Jaccard join", one_of_each_group), ("packing", packed)]

#: Hashed n-gram weights, groups of similar lines and BPE ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again; what no later stage reads is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/patchloom-pipeline-{uuid.uuid4().hex}"
            done.write.parquet(path)
            done = spark.read.parquet(path)
            if before is not None:
                drop_stash(before)
            before = done
        docs = done
    return docs
