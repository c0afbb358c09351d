"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import brown_lm, chosen_path, cross_polytope, fuzzy_lines, gif, gumbel_pieces, hilbert_pack, label_shards, prefix_trie, snapshots, spot_signatures, toxicity, whitening
from patchloom.llm.common import table


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_and_describe(table(spark, sf_dir, "documents"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(table(spark, sf_dir, "documents"))


def op4_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.render(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op7_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gumbel_pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the search for changes that are spread over a line, which takes most of the time."""
    return fuzzy_lines.decide(table(spark, sf_dir, "documents"), spread=True).drop("version")


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(table(spark, sf_dir, "documents"))


def op10_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_shards.shards(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's deviation is the sum of squares; the operator's plain sum follows as `shift`."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "component", "n", F.col("squares").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("shift"))


def op13_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.compare(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_gif, op2_cross_polytope, op3_chosen_path, op4_snapshots, op5_toxicity, op6_hilbert_pack, op7_gumbel_pieces, op8_fuzzy_lines, op9_brown_lm, op10_label_shards, op11_prefix_trie, op12_whitening, op13_spot_signatures)
}

#: All pairs of the embeddings table by cosine in double precision.
_OP2 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

#: Exact Jaccard similarities by an inverted index of the five-word shingles.
_OP3 = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE CAST(k AS DOUBLE) / (x.n + y.n - k) >= 0.8),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a),
n AS (SELECT a AS doc_id, count(*) AS n FROM l GROUP BY a)
SELECT c.doc_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c.doc_id = class_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

ORACLES: dict[str, str] = {"op2_cross_polytope": _OP2, "op3_chosen_path": _OP3, "op4_snapshots": snapshots.ORACLE_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL}
