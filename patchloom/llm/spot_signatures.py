"""Fingerprints by spot signatures: chains of content words behind common words, compared as sets.

A common word is an anchor; it and the next content words behind it, other
anchors skipped, are one signature. A document's fingerprint is the set of its
signatures. Two sets can only be as alike as their sizes allow, so sets are
partitioned by length, and most pairs are settled before signatures are counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.common import cut, only

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "be", "by", "as", "this", "are", "at", "from",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "qui", "par", "dans", "sur", "au", "pas", "avec",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "für", "ist", "nicht", "dem", "im", "ein", "als", "eine",
    "el", "y", "los", "se", "del", "las", "por", "no", "con", "su", "una", "es", "para", "al", "lo",
)
#: Content words of a chain.
CHAIN = 2
THRESHOLD = 0.8


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted set of hashed signatures of a text; null counts as empty.

    Chains at the end of a text may be shorter. In a text without an anchor every
    word is one, and a text without a word has one signature, the text itself, so
    that no set is empty and texts with equal sets are alike.
    """
    body = F.coalesce(text, F.lit(""))
    common = lambda w: w.isin(*anchors)

    def chains(w: Column) -> Column:
        content = F.filter(w, lambda x: ~common(x))
        spots = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda s: common(s["word"]))
        # Behind the t-th anchor, at place i of all words, the next content word is number i - t.
        behind = lambda both: F.transform(both["spots"], lambda s, t: F.xxhash64(s["word"], *[F.get(both["content"], s["at"] - t + k) for k in range(chain)]))
        return _let(F.struct(spots.alias("spots"), content.alias("content")), behind)

    every = lambda w: F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + 1 + k) for k in range(chain)]))
    words = F.filter(F.split(F.lower(body), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    found = _let(words, lambda w: F.when(F.size(w) == 0, F.array(F.xxhash64(body))).when(F.exists(w, common), chains(w)).otherwise(every(w)))
    return F.sort_array(F.array_distinct(found))


def shown(signatures: Column) -> Column:
    """A fingerprint as text: sixteen hexadecimal digits a signature."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sorted sets; sets that are equal or lie apart are not intersected."""
    common = F.size(F.array_intersect(a, b))
    last = lambda x: F.element_at(x, -1)
    apart = (last(a) < F.get(b, F.lit(0))) | (last(b) < F.get(a, F.lit(0)))
    return F.when(a == b, 1.0).when(apart, 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def _partition(size: Column, threshold: float) -> Column:
    """The class of a set's length; sets that are alike are in one class or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / -math.log(threshold) + 1e-9).cast("int")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(key, set_id) of all documents, and (a, b, likeness) of all pairs a < b of different sets whose likeness is the threshold or more.

    set_id is a hash of 64 bits of the set. Documents of equal sets are one set, however
    many they are. A set meets those of its class of length and of the next one, by its rarest
    signatures: sets that are alike share one of the first size - ceil(threshold * size) + 1.
    Sizes settle most of what meets; the rest is intersected.
    """
    rows = only(docs, key, text).select(key, signatures(F.col(text)).alias("s"))
    rows = rows.withColumn("set_id", F.xxhash64("s"))
    member = cut(rows.select(key, "set_id"))
    sets = cut(rows.select("set_id", "s").dropDuplicates(["set_id"]))
    each = sets.select("set_id", F.size("s").alias("size"), F.explode("s").alias("x"))
    count = each.groupBy("x").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy("n", "x"))
    prefix = each.join(count, "x").withColumn("rank", rank).filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
    prefix = cut(prefix.select("set_id", "size", "x", _partition(F.col("size"), threshold).alias("part")))
    probe = prefix.select(F.col("set_id").alias("a"), F.col("size").alias("n"), "x", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    other = prefix.select(F.col("set_id").alias("b"), F.col("size").alias("m"), "x", "part")
    met = probe.join(other, ["part", "x"]).filter("a <> b").filter(F.least("n", "m") >= F.greatest("n", "m") * threshold - 1e-9)
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = met.join(sets.select(F.col("set_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("s").alias("sb")), "b")
    return member, both.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") >= threshold - 1e-12)


def _next(ids: DataFrame) -> DataFrame:
    """(doc_id, h, n, next_id, next_h): each document with the one after it, the last with the first.

    Ids are sorted over all tasks; the last of a task gets the first of the task after it, from a table of one row a task.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    # The task of a row must not change, so it is written before anything depends on it.
    dealt = cut(ids.repartitionByRange(*order).withColumn("task", F.spark_partition_id()))
    named = F.struct("doc_id", "h")
    firsts = dealt.groupBy("task").agg(F.min(named).alias("first"))
    tasks = Window.orderBy("task")
    after = firsts.select("task", F.coalesce(F.lead("first").over(tasks), F.first("first").over(tasks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    rows = dealt.withColumn("follows", F.lead(named).over(Window.partitionBy("task").orderBy(*order))).join(F.broadcast(after), "task")
    follows = F.coalesce("follows", "after")
    return rows.select("doc_id", "h", "n", follows["doc_id"].alias("next_id"), follows["h"].alias("next_h"))


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures.

    The edited text has the last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document, by key, nulls first; the last is followed by the
    first, and one document alone by itself. Documents of one key follow each other by a hash of
    their texts; rows that repeat in key and text have the same place, and a row each. Null
    texts count as empty. An empty table gives no rows.

    Only keys and lengths are put in order. Texts are shuffled once, by document;
    what the next document gives, its beginning and its fingerprint, is sent to the one before.
    """
    rows = only(docs, key, text).select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = rows.select("doc_id", "h", F.char_length("text").alias("n"))
    once = ids.distinct()
    chain = cut(_next(once))
    givers = rows.dropDuplicates(["doc_id", "h"]) if ids.count() > chain.count() else rows
    same = lambda i, h: F.col("r.doc_id").eqNullSafe(F.col(i)) & (F.col("r.h") == F.col(h))
    given = givers.alias("r").join(chain.alias("c"), same("c.next_id", "c.next_h"))
    given = given.select(F.col("c.doc_id").alias("to_id"), F.col("c.h").alias("to_h"), F.expr("left(r.text, c.n div 4)").alias("beginning"), signatures(F.col("r.text")).alias("next_signatures"))
    met = rows.alias("r").join(given.alias("g"), same("g.to_id", "g.to_h")).select("r.doc_id", "r.text", "g.beginning", "g.next_signatures")
    n = F.char_length("text")
    met = met.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_signatures", F.concat(F.expr("left(text, char_length(text) - char_length(text) div 4)"), "beginning").alias("edited"))
    met = met.select("doc_id", "n_chars", "next_signatures", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), signatures(F.col("text")).alias("s"), signatures(F.col("edited")).alias("e"))
    return met.select(
        F.col("doc_id").alias(key), "n_chars", "edited_sha256", shown(F.col("s")).alias("fingerprint"), shown(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("next_signatures")).alias("near_next"), F.size("s").cast("long").alias("n_signatures"),
    )
