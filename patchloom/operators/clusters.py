"""Equivalence classes of patches: components, representatives, statistics and comparison of clusterings."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

#: Edges from which on they are contracted by joins; fewer are by one task, as a round of joins takes seconds however small it is.
TAIL = 500_000


def _shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where that is unset and all runs in one process, a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="patchloom-"))
    return sc.getCheckpointDir()


def _recovery_point(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there: the plan ends there, and its real size is known to what follows."""
    spark = df.sparkSession
    path = f"{_shared_dir(spark)}/patchloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _counted(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
    """A recovery point, and how many of its rows there are (or meet the condition), counted as they are written."""
    seen = Observation()
    done = _recovery_point(df.observe(seen, F.count(F.lit(1) if which is None else F.when(which, 1)).alias("n")))
    return done, seen.get["n"]


def contract(u: np.ndarray, v: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Contraction of edges between the nodes 0 to n - 1, the least first: per round nodes, the edge each chose (its place), and the node it went into."""
    edge = np.flatnonzero(u != v)
    u, v = u[edge], v[edge]
    while len(edge):
        place = np.arange(len(edge))
        pick = np.full(n, len(edge))
        np.minimum.at(pick, u, place)
        np.minimum.at(pick, v, place)
        ids = np.flatnonzero(pick < len(edge))
        up = np.arange(n)
        up[ids] = u[pick[ids]] + v[pick[ids]] - ids
        # Choices lead to two nodes that chose each other; the smaller of both is the root.
        roots = ids[(up[up[ids]] == ids) & (ids < up[ids])]
        up[roots] = roots
        while (up[up] != up).any():
            up = up[up]
        yield ids, edge[pick[ids]], up[ids]
        x, y = up[u], up[v]
        # Of edges between the same two the first is the least.
        _, first = np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_index=True)
        first = np.sort(first[x[first] != y[first]])
        edge, u, v = edge[first], x[first], y[first]


def _tail_levels(edges: DataFrame) -> list[DataFrame]:
    """`spanning_levels` of few edges (u, v, rank) in one task, which gets them by rank."""
    plain = edges.schema["u"].dataType.typeName() in ("long", "integer", "string")
    named = lambda c: (F.col(c) if plain else F.to_json(F.struct(F.col(c).alias("x")))).alias(f"{c}_name")
    rows = edges.coalesce(1).sortWithinPartitions("rank").select("u", "v", "rank", named("u"), named("v"))
    kind = StructType([StructField("round", IntegerType()), StructField("id", edges.schema["u"].dataType), StructField("least", edges.schema["rank"].dataType), StructField("up", edges.schema["u"].dataType)])
    schema = to_arrow_schema(kind)

    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := list(batches)):
            return
        all_ = pa.Table.from_batches(got)
        ends, names = (pa.concat_arrays([c for k in "uv" for c in all_.column(k + x).chunks]) for x in ("", "_name"))
        names = names.dictionary_encode()
        code = names.indices.to_numpy()
        # A place of each node's name.
        n, (_, at) = len(names.dictionary), np.unique(code, return_index=True)
        ranks = all_.column("rank").combine_chunks()
        for i, (ids, least, up) in enumerate(contract(code[: len(all_)].astype(np.int64), code[len(all_) :].astype(np.int64), n)):
            done = pa.table([pa.array(np.full(len(ids), i, np.int32)), ends.take(pa.array(at[ids])), ranks.take(pa.array(least)), ends.take(pa.array(at[up]))], names=["round", "id", "least", "up"]).cast(schema)
            yield from done.to_batches(max_chunksize=10_000)

    done = _recovery_point(rows.mapInArrow(rounds, kind))
    last = done.agg(F.max("round")).first()[0]
    return [done.filter(F.col("round") == i).select("id", "least", "up") for i in range(last + 1)]


def spanning_levels(edges: DataFrame) -> list[DataFrame]:
    """Contraction of edges (u, v, rank), least ranks first: per round (id, least, up), the rank each part chose and the part it went into.

    Ranks differ. The chosen ranks of all rounds are the edges of the minimum spanning forest. What is left of at most
    TAIL edges is contracted in the same rounds by one task.
    """
    levels: list[DataFrame] = []
    e, left = _counted(edges.select("u", "v", "rank").filter("u <> v"))
    while left:
        if left <= TAIL:
            return levels + _tail_levels(e)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "rank"))
        pick = both.groupBy("u").agg(F.min(F.struct("rank", "v")).alias("m")).select(F.col("u").alias("id"), F.col("m.rank").alias("least"), F.col("m.v").alias("to"))
        level = _recovery_point(pick)
        # Choices lead to two parts that chose each other; the smaller of both is the root, and pointers to it are doubled.
        back = level.select(F.col("id").alias("to"), F.col("to").alias("back"))
        level = level.join(back, "to").select("id", "least", F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("to")), F.col("id")).otherwise(F.col("to")).alias("up"))
        moved = 1
        while moved:
            there = level.select(F.col("id").alias("up"), F.col("up").alias("next"))
            twice = level.join(there, "up").select("id", "least", "up", "next")
            there = twice.select(F.col("id").alias("next"), F.col("next").alias("last"))
            level, moved = _counted(twice.join(there, "next").select("id", "least", "up", "last"), F.col("last") != F.col("up"))
            level = level.select("id", "least", F.col("last").alias("up"))
        levels.append(level)
        up = level.select("id", "up")
        e = e.join(up.select(F.col("id").alias("u"), F.col("up").alias("x")), "u").join(up.select(F.col("id").alias("v"), F.col("up").alias("y")), "v").filter("x <> y")
        e, left = _counted(e.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.min("rank").alias("rank")))
    return levels


def tree_labels(levels: list[DataFrame], kind: DataType) -> DataFrame:
    """(id, cluster_id): every node of the contracted edges, with the smallest node of its part, from `spanning_levels`."""
    if not levels:
        return SparkSession.active().createDataFrame([], StructType([StructField("id", kind), StructField("cluster_id", kind)]))
    top = levels[0].select("id", F.col("up").alias("part"))
    for level in levels[1:]:
        top = top.join(level.select(F.col("id").alias("part"), "up"), "part", "left").select("id", F.coalesce("up", "part").alias("part"))
    top = _recovery_point(top)
    return top.join(top.groupBy("part").agg(F.min("id").alias("cluster_id")), "part").select("id", "cluster_id")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, cluster_id): connected components of edges (a, b), named by their smallest id; nodes without an edge are their own.

    Every part goes into the one across its least edge, so that rounds grow with the logarithm of the number of nodes, however
    long paths are, and each has half as many parts at most.
    """
    edge = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    labels = tree_labels(spanning_levels(edge.withColumn("rank", F.struct("u", "v"))), edges.schema["a"].dataType)
    if nodes is None:
        return labels
    return nodes.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))


def representative(members: DataFrame, key: Column) -> DataFrame:
    """(cluster_id, representative): the downstream member with the largest key, then the largest id."""
    return members.filter(~F.col("is_upstream")).groupBy("cluster_id").agg(F.max(F.struct(key.alias("k"), "id")).alias("m")).select("cluster_id", F.col("m.id").alias("representative"))


def statistics(members: DataFrame) -> DataFrame:
    """One row of counts and size histograms over (id, cluster_id, is_upstream)."""
    sizes = members.groupBy("cluster_id").agg(F.count_if(~F.col("is_upstream")).alias("down"), F.count_if("is_upstream").alias("up"))
    hist = [F.count_if(F.col(side) == n).alias(f"{side}_{n}") for side in ("down", "up") for n in (1, 2, 3, 4)]
    more = [F.count_if(F.col(side) >= 5).alias(f"{side}_5_more") for side in ("down", "up")]
    return sizes.agg(F.count("*").alias("clusters"), F.sum("down").alias("downstream"), F.sum("up").alias("upstream"), F.count_if((F.col("up") > 0) & (F.col("down") > 0)).alias("integrated"), *hist, *more)


def contingency(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(t, p, n) of two clusterings (id, cluster_id); an id that one of them lacks is a cluster of its own there."""
    both = intermix(truth, predicted)
    return both.groupBy("t", "p").agg(F.count("*").alias("n"))


def intermix(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(id, t, p): all ids of either clustering; t or p of an id that is missing there names a cluster that holds nothing else."""
    a, b = truth.select("id", F.struct(F.lit(0).alias("own"), F.col("cluster_id").alias("name")).alias("t")), predicted.select("id", F.struct(F.lit(0).alias("own"), F.col("cluster_id").alias("name")).alias("p"))
    own = F.struct(F.lit(1).alias("own"), F.col("id").alias("name"))
    return a.join(b, "id", "full").select("id", F.coalesce("t", own).alias("t"), F.coalesce("p", own).alias("p"))


def identical(left: DataFrame, right: DataFrame) -> DataFrame:
    """(cluster_id, other_id) of clusters with the same members in both clusterings.

    Members are compared by their number and two sums of hashes, not as lists.
    """
    def marks(x: DataFrame, name: str) -> DataFrame:
        return x.select("id", "cluster_id").distinct().groupBy(F.col("cluster_id").alias(name)).agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(38,0)")).alias("g"))
    return marks(left, "cluster_id").join(marks(right, "other_id"), ["n", "h", "g"]).select("cluster_id", "other_id")


def remove(members: DataFrame, ids: DataFrame) -> DataFrame:
    """The clustering without the given ids; clusters left empty are gone."""
    return members.join(ids.select("id"), "id", "left_anti").select(*members.columns)


def mark_upstream(members: DataFrame, ids: DataFrame, upstream: bool = True) -> DataFrame:
    """The clustering with the given ids marked as upstream, or no longer so."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return members.join(hit, "id", "left").withColumn("is_upstream", F.when(F.col("_hit"), F.lit(upstream)).otherwise(F.col("is_upstream"))).select(*members.columns)


def rip_up(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """The clustering with every member of the given clusters (cluster_id) alone in a cluster named by it."""
    hit = clusters.select("cluster_id").distinct().withColumn("_hit", F.lit(True))
    return members.join(hit, "cluster_id", "left").withColumn("cluster_id", F.when(F.col("_hit"), F.col("id")).otherwise(F.col("cluster_id"))).select(*members.columns)


def insert(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, cluster_id) after the members of each group (group, id) were put into one cluster, which merges the clusters they were in."""
    head = groups.groupBy("group").agg(F.min("id").alias("head"))
    edges = groups.join(head, "group").select(F.col("head").alias("a"), F.col("id").alias("b"))
    first = members.groupBy("cluster_id").agg(F.min("id").alias("head"))
    kept = members.join(first, "cluster_id").select(F.col("head").alias("a"), F.col("id").alias("b"))
    return components(kept.unionByName(edges), members.select("id").unionByName(groups.select("id")))


def merge_delta(members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cluster_id, into) of the clusters that new edges (a, b) join to another, and (id, cluster_id) of ids that were not known.

    Components are those of the edges alone, between the clusters of their ends: old edges and members that no edge
    touches take no part, so that the work grows with what is new. Clusters are named by their smallest id.
    """
    e = _recovery_point(edges.select("a", "b").filter("a is not null and b is not null").distinct())
    ids = e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    label = _recovery_point(ids.join(members.select("id", "cluster_id"), "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"), F.col("cluster_id").isNull().alias("new")))
    named = label.select("id", "cluster_id")
    met = e.join(named.select(F.col("id").alias("a"), F.col("cluster_id").alias("x")), "a").join(named.select(F.col("id").alias("b"), F.col("cluster_id").alias("y")), "b")
    into = components(met.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("id").alias("cluster_id"), F.col("cluster_id").alias("into"))
    known = members.select("cluster_id").join(into, "cluster_id", "left_semi").distinct()
    new = label.filter("new").select("id", "cluster_id").join(into, "cluster_id", "left").select("id", F.coalesce("into", "cluster_id").alias("cluster_id"))
    return into.filter("cluster_id <> into").join(known, "cluster_id", "left_semi"), new


def write_version(members: DataFrame, edges: DataFrame, store: str, version: int) -> None:
    """Adds what new edges change to a store as its next version; version 0 holds all members (id, cluster_id). A version that is written again is replaced."""
    if not version:
        members.select("id", "cluster_id").write.mode("overwrite").parquet(f"{store}/new/version=0")
        return
    delta, new = merge_delta(at_version(members.sparkSession, store, version - 1), edges)
    delta.write.mode("overwrite").parquet(f"{store}/into/version={version}")
    new.write.mode("overwrite").parquet(f"{store}/new/version={version}")


def at_version(spark: SparkSession, store: str, version: int) -> DataFrame:
    """(id, cluster_id) of a store as of a version: cluster names are followed through all changes up to it."""
    rows = spark.read.parquet(f"{store}/new").filter(F.col("version") <= version)
    if not version:
        return rows.select("id", "cluster_id")
    steps = spark.read.parquet(f"{store}/into").filter(F.col("version") <= version)
    into = components(steps.select(F.col("cluster_id").alias("a"), F.col("into").alias("b"))).select(F.col("id").alias("cluster_id"), F.col("cluster_id").alias("into"))
    return rows.select("id", "cluster_id").join(into, "cluster_id", "left").select("id", F.coalesce("into", "cluster_id").alias("cluster_id"))


def related(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, related): all ids of the set (set, id) are known and in one cluster."""
    found = sets.join(members.select("id", "cluster_id"), "id", "left")
    return found.groupBy("set").agg(((F.count_distinct("cluster_id") == 1) & F.bool_and(F.col("cluster_id").isNotNull())).alias("related"))


def not_false_positive(pairs: DataFrame, members: DataFrame, false_positives: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not known to be wrong.

    A pair is wrong where a false positive (origin, dest) begins at a downstream
    member of a's cluster and ends in b's cluster. Ids without a cluster are one of their own.
    """
    label = lambda rows, col, name: rows.join(members.select(F.col("id").alias(col), F.col("cluster_id").alias(name)), col, "left").withColumn(name, F.coalesce(name, col))
    down = members.filter(~F.col("is_upstream")).select(F.col("id").alias("origin"))
    strangers = false_positives.join(members.select(F.col("id").alias("origin")), "origin", "left_anti")
    known = false_positives.join(down, "origin", "left_semi").unionByName(strangers)
    wrong = label(label(known, "origin", "ca"), "dest", "cb").select("ca", "cb").distinct()
    return label(label(pairs, "a", "ca"), "b", "cb").join(wrong, ["ca", "cb"], "left_anti").select(*pairs.columns)


def unreachable(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members that neither a repository nor a mailbox (id) has."""
    return members.join(known.select("id"), "id", "left_anti")


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def pair_counts(table: DataFrame) -> DataFrame:
    """tp, fp, fn, tn over pairs of elements, precision, recall, f, without making a pair."""
    t = table.groupBy("t").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("same_t"), F.sum("n").alias("total"))
    p = table.groupBy("p").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("same_p"))
    both = table.agg(F.sum(_pairs(F.col("n"))).alias("tp"))
    # Three tables of one row each.
    one = both.crossJoin(p).crossJoin(t)
    tp, fp, fn = F.col("tp"), F.col("same_p") - F.col("tp"), F.col("same_t") - F.col("tp")
    tn = _pairs(F.col("total")) - tp - fp - fn
    return one.select(*[c.cast("long").alias(n) for c, n in ((tp, "tp"), (fp, "fp"), (fn, "fn"), (tn, "tn"))], (tp / (tp + fp)).alias("precision"), (tp / (tp + fn)).alias("recall"), (2 * tp / (2 * tp + fp + fn)).alias("f"))


def entropy_scores(table: DataFrame) -> DataFrame:
    """homogeneity, completeness, v_measure, mutual information (nats), NMI, adjusted Rand, Fowlkes-Mallows, purity."""
    n = F.col("n")
    xlogx = lambda c: F.sum(F.when(c > 0, c * F.log(c)))
    t = table.groupBy("t").agg(F.sum("n").alias("n"), F.max("n").alias("best")).agg(xlogx(n).alias("tx"), F.sum(n * (n - 1) / 2).alias("t2"), F.sum("n").alias("total"), F.sum("best").alias("hits"))
    p = table.groupBy("p").agg(F.sum("n").alias("n")).agg(xlogx(n).alias("px"), F.sum(n * (n - 1) / 2).alias("p2"))
    both = table.agg(xlogx(n).alias("bx"), F.sum(n * (n - 1) / 2).alias("b2"))
    one = both.crossJoin(p).crossJoin(t)
    total = F.col("total")
    log_n = F.log(total)
    h_t, h_p = log_n - F.col("tx") / total, log_n - F.col("px") / total
    mi = log_n + (F.col("bx") - F.col("tx") - F.col("px")) / total
    hom = F.when(h_t <= 1e-12, F.lit(1.0)).otherwise(mi / h_t)
    com = F.when(h_p <= 1e-12, F.lit(1.0)).otherwise(mi / h_p)
    v = F.when(hom + com <= 1e-12, F.lit(0.0)).otherwise(2 * hom * com / (hom + com))
    all_pairs = total * (total - 1) / 2
    expected = F.col("t2") * F.col("p2") / all_pairs
    ari = F.when(F.abs((F.col("t2") + F.col("p2")) / 2 - expected) < 1e-12, F.lit(1.0)).otherwise((F.col("b2") - expected) / ((F.col("t2") + F.col("p2")) / 2 - expected))
    fm = F.when((F.col("t2") == 0) | (F.col("p2") == 0), F.lit(0.0)).otherwise(F.col("b2") / F.sqrt(F.col("t2") * F.col("p2")))
    return one.select(hom.alias("homogeneity"), com.alias("completeness"), v.alias("v_measure"), mi.alias("mutual_information"), v.alias("nmi"), ari.alias("adjusted_rand"), fm.alias("fowlkes_mallows"), (F.col("hits") / total).alias("purity"))


def adjusted_mutual_information(table: DataFrame) -> DataFrame:
    """One row, ami: mutual information above what clusterings of the same sizes have by chance, by the mean of both entropies.

    Clusters of equal size share a term, so that the terms are pairs of different
    sizes, of which there are about as many as elements at most; they are summed in Spark.
    """
    n = F.col("n")
    xlogx = lambda c: F.sum(F.when(c > 0, c * F.log(c)))
    t, p = table.groupBy("t").agg(F.sum("n").alias("n")), table.groupBy("p").agg(F.sum("n").alias("n"))
    tt = t.agg(xlogx(n).alias("tx"), F.sum("n").alias("total"), F.count("*").alias("ts"))
    one = tt.crossJoin(p.agg(xlogx(n).alias("px"), F.count("*").alias("ps"))).crossJoin(table.agg(xlogx(n).alias("bx")))
    total = tt.first()["total"] or 0
    rows, cols = t.groupBy(F.col("n").alias("a")).agg(F.count("*").alias("fa")), p.groupBy(F.col("n").alias("b")).agg(F.count("*").alias("fb"))
    # Different sizes: at most the square root of twice the number of elements on either side.
    sizes = rows.crossJoin(cols)
    terms = sizes.mapInArrow(_expected(total), "e double").agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("expected"))
    log_n = F.log("total")
    h_t, h_p = log_n - F.col("tx") / F.col("total"), log_n - F.col("px") / F.col("total")
    mi = log_n + (F.col("bx") - F.col("tx") - F.col("px")) / F.col("total")
    ami = (mi - F.col("expected")) / ((h_t + h_p) / 2 - F.col("expected"))
    same = ((F.col("ts") == 1) & (F.col("ps") == 1)) | ((F.col("ts") == F.col("total")) & (F.col("ps") == F.col("total")))
    return one.crossJoin(terms).select(F.when(same, 1.0).otherwise(ami).alias("ami"))


def _expected(total: int):  # noqa: ANN202
    """For rows (a, fa, b, fb), sizes and how often they occur, their part of the expected mutual information in nats."""
    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            out = [fa * fb * _expected_pair(a, b, total) for a, fa, b, fb in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["e"])
    return run


def _expected_pair(a: int, b: int, n: int) -> float:
    lg = math.lgamma
    out = 0.0
    for k in range(max(1, a + b - n), min(a, b) + 1):
        log_p = lg(a + 1) + lg(b + 1) + lg(n - a + 1) + lg(n - b + 1) - lg(n + 1) - lg(k + 1) - lg(a - k + 1) - lg(b - k + 1) - lg(n - a - b + k + 1)
        out += k / n * math.log(n * k / (a * b)) * math.exp(log_p)
    return out


def expected_mutual_information(rows: list[int], cols: list[int]) -> float:
    """Expected mutual information (nats) of clusterings with the given sizes."""
    n = sum(rows)
    return sum(_expected_pair(a, b, n) for a in rows for b in cols)
