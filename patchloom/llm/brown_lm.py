"""Brown class-based bigrams: exchange clustering of words, class transitions and word emissions.

Every word belongs to an item: each of the `FREQUENT` most frequent training words
is one of its own, the others share `ENDINGS` items by their last bytes. Item
bigrams are counted over all training documents. Exchange clustering moves items
between `CLASSES` classes by the change of the class-bigram likelihood; half of
the items may move in a round, all at once. The model is
P(w | v) = P(class(w) | class(v)) * P(w | class(w)), both smoothed, and sums to
one over the known words and one unknown word per class.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import crc_of_id, cut, drop_stash, only, stash

CLASSES = 64
FREQUENT = 8192
ENDINGS = 2048
#: So many words at most have their counts broadcast; the counts of the others are joined.
BROADCAST_WORDS = 131_072
ROUNDS = 4
#: Weight of the class unigram in a class transition, and what is added to each word's count.
BACKOFF, ADDED = 20.0, 1.0
#: The end of a text; no word can be equal to it.
END = b"\n"
ITEMS = 1 + FREQUENT + ENDINGS
FLUSH = 400_000


def tokens(text: str | None) -> list[bytes]:
    """Words between the six white-space bytes, A-Z in lower case, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


class Items(dict):
    """Item numbers of words: 0 is the end, then the frequent words by rank, then the endings."""

    def __init__(self, frequent: list[bytes]):
        super().__init__({w: i + 1 for i, w in enumerate(frequent)})
        self[END] = 0
        self.fixed = len(self)
        self.frequent = frequent

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.fixed + 1_000_000:
            self.__init__(self.frequent)
        item = self[word] = 1 + FREQUENT + zlib.crc32(word[-3:]) % ENDINGS
        return item


def phi(x: np.ndarray) -> np.ndarray:
    """x log x, zero at zero."""
    return x * np.log(np.maximum(x, 1e-300))


def gains(right: np.ndarray, left: np.ndarray, of: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Change of the class-bigram log likelihood if item i went to class b, as (items, classes).

    right[i], left[i]: counts of the classes after and before item i; of: its class
    now, -1 for none; table: class bigrams. An item's own repetitions count with the
    class it is in.
    """
    out = np.zeros((len(right), len(table)))
    for i, a in enumerate(of.tolist()):
        t = table.copy()
        r, p = right[i], left[i]
        if a >= 0:
            t[a] = np.maximum(t[a] - r, 0)
            t[:, a] = np.maximum(t[:, a] - p, 0)
        rows, cols = t.sum(axis=1), t.sum(axis=0)
        seen, came = np.flatnonzero(r), np.flatnonzero(p)
        after, before = t[:, seen], t[came].T
        gain = (phi(after + r[seen]) - phi(after)).sum(axis=1) + (phi(before + p[came]) - phi(before)).sum(axis=1)
        out[i] = gain - (phi(rows + r.sum()) - phi(rows)) - (phi(cols + p.sum()) - phi(cols))
    return out


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """word, n over all documents given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return rows

        for batch in batches:
            for t in batch.column(0).to_pylist():
                found.update(tokens(t))
                if len(found) > FLUSH:
                    yield told()
        if found:
            yield told()

    return only(docs, text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_bigrams(docs: DataFrame, text: str, frequent: list[bytes]) -> DataFrame:
    """a, b, n: how often item b follows item a; the first word of a text follows an end."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value)
        parts: list[np.ndarray] = []
        size = 0

        def told() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((codes // ITEMS).astype(np.int32)), pa.array((codes % ITEMS).astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = tokens(t)
                at = np.fromiter(map(items.__getitem__, words), dtype=np.int64, count=len(words))
                parts.append(np.r_[0, at[:-1]] * ITEMS + at)
                size += len(at)
                if size > 8_000_000:
                    yield told()
                    parts, size = [], 0
        if parts:
            yield told()

    return only(docs, text).mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def exchange(bigrams: DataFrame, seeds: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes by item, and the class bigrams under them. The class map has ITEMS entries, whatever the corpus."""
    spark = bigrams.sparkSession
    of = np.full(ITEMS, -1, dtype=np.int64)
    of[0] = 0
    # Each class begins with one of the most frequent words; the rest joins in the first round.
    n = min(seeds, classes - 1)
    of[1 : n + 1] = np.arange(1, n + 1)

    def sides(of: np.ndarray) -> tuple[DataFrame, DataFrame]:
        pairs = [(i, int(c)) for i, c in enumerate(of) if c >= 0]
        cmap = F.broadcast(spark.createDataFrame(pairs, "item int, cls int"))
        right = bigrams.join(cmap.withColumnRenamed("item", "b"), "b").groupBy(F.col("a").alias("item"), "cls").agg(F.sum("n").alias("n"))
        left = bigrams.join(cmap.withColumnRenamed("item", "a"), "a").groupBy(F.col("b").alias("item"), "cls").agg(F.sum("n").alias("n"))
        return right, left

    def table_of(right: DataFrame, of: np.ndarray) -> np.ndarray:
        table = np.zeros((classes, classes))
        cmap = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(of) if c >= 0], "item int, own int"))
        for r in right.join(cmap, "item").groupBy("own", "cls").agg(F.sum("n").alias("n")).collect():
            table[r.own, r.cls] = r.n
        return table

    for turn in range(rounds + 1):
        right, left = sides(of)
        right, left = cut(right), left
        table = table_of(right, of)
        both = right.select("item", F.col("cls").alias("spot"), "n").unionByName(left.select("item", (F.col("cls") + classes).alias("spot"), "n"))
        lists = both.groupBy("item").agg(F.collect_list(F.struct("spot", "n")).alias("counts"))
        now = of.copy()

        def best(batches: Iterator[pa.RecordBatch], now: np.ndarray = now, table: np.ndarray = table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                counts = np.zeros((len(ids), 2 * classes))
                for i, found in enumerate(batch.column(1).to_pylist()):
                    for x in found:
                        counts[i, x["spot"]] = x["n"]
                g = gains(counts[:, :classes], counts[:, classes:], now[ids], table)
                g[:, 0] = -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(g.argmax(axis=1).astype(np.int32))], ["item", "cls"])

        for r in lists.mapInArrow(best, "item int, cls int").collect():
            first = turn == 0 and of[r.item] < 0
            if r.item and (first or turn and (zlib.crc32(b"%d" % r.item) + turn) % 2 == 0):
                now[r.item] = r.cls
        if turn == 0:
            rest = np.flatnonzero(now < 0)
            now[rest] = 1 + rest % (classes - 1)
        of = now
    right, _ = sides(of)
    return of, table_of(right, of)


def _least_count(counts: DataFrame, most: int = BROADCAST_WORDS) -> int:
    """The smallest count such that at most `most` words occur so often or more often; words are counted by their counts, of which there are few."""
    levels = counts.filter(F.col("word") != F.lit(END)).groupBy("n").agg(F.count("*").alias("words"))
    least, held = 1 << 62, 0
    for r in levels.orderBy(F.desc("n")).limit(most + 1).collect():
        held += r.words
        if held > most:
            break
        least = r.n
    return least


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out (crc32 of the key as text mod 7 is
    not 2) and scores every row, whole texts. Null texts count as empty and
    consist of their end. Repeated rows are learned from and scored each. Without
    a training row every count is zero: a token then has the probability 1 / (N + V + 1) = 1
    in the base, and in the model that of an unknown word.
    """
    spark = docs.sparkSession
    docs = only(docs, key, text)
    kind = docs.schema[key].dataType.simpleString()
    held = F.pmod(crc_of_id(key), F.lit(7)) == 2
    training = docs.filter(~held)
    counts = stash(count_words(training, text))
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = _least_count(counts)
    # At most BROADCAST_WORDS rows, by the choice of the least count.
    top = sorted(counts.filter((F.col("word") != F.lit(END)) & (F.col("n") >= least)).collect(), key=lambda r: (-r.n, bytes(r.word)))
    known = [bytes(r.word) for r in top]
    frequent = known[:FREQUENT]
    bigrams = stash(count_bigrams(training, text, frequent))
    of, table = exchange(bigrams, len(frequent))
    drop_stash(bigrams)

    # Words and tokens of every class: at most CLASSES rows of a count over the whole vocabulary.
    sent_frequent = spark.sparkContext.broadcast((frequent, of))

    def class_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, of = Items(sent_frequent.value[0]), sent_frequent.value[1]
        n, v = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            cls = of[np.fromiter(map(items.__getitem__, batch.column(0).to_pylist()), dtype=np.int64, count=batch.num_rows)]
            np.add.at(n, cls, batch.column(1).to_numpy())
            np.add.at(v, cls, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(n), pa.array(v)], ["cls", "n", "v"])

    sizes = counts.mapInArrow(class_sizes, "cls int, n long, v long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sizes.collect():
        class_n[r.cls], class_v[r.cls] = r.n, r.v
    unigram = (class_n + 1) / (class_n.sum() + CLASSES)
    moves = np.log10((table + BACKOFF * unigram) / (table.sum(axis=1, keepdims=True) + BACKOFF))
    below = np.log10(class_n + ADDED * (class_v + 1))
    base_below = float(np.log10(total + types + 1.0))
    sent = spark.sparkContext.broadcast((known, np.array([r.n for r in top], dtype=np.float64), of, moves, below))
    ends = total and counts.filter(F.col("word") == F.lit(END)).select("n").first().n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_n, of, moves, below = sent.value
        items = Items(known[:FREQUENT])
        place = {w: i for i, w in enumerate(known)}
        place[END] = len(known)
        logs = np.log10(np.r_[known_n, ends, 0.0] + 1)
        emit = np.log10(np.r_[known_n, ends] + ADDED)
        for batch in batches:
            rows, rare_words, rare_n = [], [], []
            for t in batch.column(1).to_pylist():
                words = tokens(t)
                spot = np.fromiter((place.get(w, -1) for w in words), dtype=np.int64, count=len(words))
                cls = of[np.fromiter(map(items.__getitem__, words), dtype=np.int64, count=len(words))]
                hit = spot >= 0
                model = moves[np.r_[0, cls[:-1]], cls].sum() - below[cls].sum() + emit[spot[hit]].sum()
                rare = Counter(w for w, h in zip(words, hit.tolist(), strict=True) if not h)
                # The end is known as soon as there is a training row.
                rows.append((len(words), int(hit.sum()) - (0 if ends else 1), logs[spot[hit]].sum() - len(words) * base_below, model))
                rare_words.append(list(rare))
                rare_n.append(list(rare.values()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:2]), *(pa.array(c, pa.float64()) for c in cols[2:]), pa.array(rare_words, pa.list_(pa.binary())), pa.array(rare_n, pa.list_(pa.int32()))],
                [key, "n_tokens", "hits", "base", "model", "words", "times"],
            )

    scored = docs.mapInArrow(run, f"`{key}` {kind}, n_tokens long, hits long, base double, model double, words array<binary>, times array<int>")
    scored = stash(scored.withColumn("uid", F.monotonically_increasing_id()))
    rare = scored.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    tail = counts.filter((F.col("word") != F.lit(END)) & (F.col("n") < least))
    # Unknown words find no row and add log10(0 + 1) = 0.
    more = rare.join(tail, "word").groupBy("uid").agg(
        F.sum("times").alias("hits2"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("base2"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(ADDED))).alias("model2")
    )
    zero = F.lit(0)
    return scored.drop("words", "times").join(more, "uid", "left").select(
        key, held.alias("held_out"), "n_tokens", (F.col("hits") + F.coalesce("hits2", zero)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero)).alias("base_score"), (F.col("model") + F.coalesce("model2", zero)).alias("score"),
    )
