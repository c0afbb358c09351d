"""The trie of conversation prefixes: rolling fingerprints, verified groups, and sums over subtrees.

Turns are sorted over all tasks, and a numpy scan in each gives every turn its
place and the polynomial fingerprint of the prefix that ends there; what a
conversation that lies in several tasks had before is carried from one to the
next. Prefixes with equal fingerprints are candidates for one node. They are
grouped by role and text of their last turn and the fingerprint before it, so
that a group whose members all equal its representative is one row, however many
they are; a fingerprint that has several rows is a collision and is split.

A node is named by its smallest member. The nodes of one name are a path, and
the paths are a tree of their own: sums over subtrees climb it by doubling, and
then run along the paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.common import cut, only

#: Fingerprints are polynomials modulo this prime at two bases; both together fill a whole number of 62 bits.
PRIME = (1 << 31) - 1
BASES = (715_225_739, 1_340_978_441)
#: A conversation begins with up to TURNS turns of the one whose id is the hundred below its own.
FAMILY, TURNS = 100, 5
#: Ids within so many numbers are joined to one text before they are hashed.
STRETCH = 4096

KEY = ["depth", "label", "salt"]


def power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo the prime."""
    out, square, e = np.ones(len(exponents), dtype=np.int64), base % prime, exponents.astype(np.int64)
    while e.any():
        out = np.where(e & 1, out * square % prime, out)
        square, e = square * square % prime, e >> 1
    return out


def scan(rows: DataFrame, key: str, order: list, terms: dict[str, int], keep: list[str], prime: int = 0, before: bool = False) -> DataFrame:
    """Rows with `place` from 1 among those of their key, and each term's running sum, modulo the prime if there is one.

    A term (a column of whole numbers) with base b counts b ** place times; with
    `before`, <term>_before is the sum without the row itself. Rows are sorted
    over all tasks, so that a key may have any number of them. Each task scans its
    stretch as if keys began with it; those that go on from one task to the next,
    at most two a task, are then corrected by what they had before.
    """
    columns = [key, *keep, *terms]
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(*columns)
    kinds = dict(dealt.dtypes)
    shown = [*terms, *(f"{t}_before" for t in terms)] if before else [*terms]
    modulo = lambda a: a % prime if prime else a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, had = None, [0] * (1 + len(terms))
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            segment = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(k)]))
            goes_on = (segment == 0) & (k[0] == last)
            place = np.arange(len(k)) - starts[segment] + 1 + goes_on * had[0]
            with_, without = [], []
            for i, base in enumerate(terms.values()):
                value = batch.column(1 + len(keep) + i).to_numpy()
                value = value if base == 1 else modulo(value * power(base, place, prime))
                upto = np.cumsum(value)
                mine = upto - (upto - value)[starts][segment] + goes_on * had[1 + i]
                with_.append(modulo(mine))
                without.append(modulo(mine - value))
            last, had = k[-1], [int(place[-1]), *(int(x[-1]) for x in with_)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(keep)], pa.array(place), *map(pa.array, with_ + without if before else with_)], names)

    names = [key, *keep, "place", *shown]
    local = dealt.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in [key, *keep]), *(f"`{c}` long" for c in ["place", *shown])]))
    local = cut(local.withColumn("_task", F.spark_partition_id()))
    ends = local.groupBy(key, "_task").agg(F.max(F.struct("place", *terms)).alias("end"))
    many = ends.withColumn("_tasks", F.count("*").over(Window.partitionBy(key))).filter("_tasks > 1").select(key, "_task", "end.*")
    carried, at, n, sums = [], None, 0, []
    # At most two keys of every task go on elsewhere.
    for r in sorted(many.collect(), key=lambda r: (r[0], r[1])):
        if r[0] != at:
            at, n, sums = r[0], 0, [0] * len(terms)
        by = [pow(b, n, prime) if prime else 1 for b in terms.values()]
        carried.append((r[0], r[1], n, *sums, *by))
        sums = [modulo(s + m * x) for s, m, x in zip(sums, by, r[3:], strict=True)]
        n += r[2]
    if not carried:
        return local.drop("_task")
    offsets = ["_n", *(f"_s_{t}" for t in terms), *(f"_m_{t}" for t in terms)]
    more = rows.sparkSession.createDataFrame(carried, f"`{key}` {kinds[key]}, _task int, " + ", ".join(f"`{o}` long" for o in offsets))
    told = local.join(F.broadcast(more), [key, "_task"], "left")

    def fixed(c: str) -> Column:
        t = c.removesuffix("_before")
        moved = F.col(f"_s_{t}") + F.col(f"_m_{t}") * F.col(c)
        return F.coalesce(moved % prime if prime else moved, F.col(c)).alias(c)

    return told.select(key, *keep, (F.col("place") + F.coalesce("_n", F.lit(0))).alias("place"), *map(fixed, shown))


def _label(f: Column, g: Column) -> Column:
    return F.shiftleft(f, 31).bitwiseOR(g)


def _fingerprints(turns: DataFrame, prime: int) -> DataFrame:
    """(conv_id, role, text, place, f, g, f_before, g_before): every turn with the fingerprints of the prefixes with it and without it."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = only(turns, "conv_id", "turn", "role", "text").filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    hashed = [(F.pmod(F.xxhash64(F.lit(i), "role", "text"), F.lit(prime - 1)) + 1).alias(c) for i, c in enumerate("fg")]
    return scan(rows.select("*", *hashed), "conv_id", [F.col("turn").asc_nulls_first(), "role", "text"], dict(zip("fg", BASES, strict=True)), ["role", "text"], prime, before=True)


def _conversations(turns: DataFrame, prime: int) -> DataFrame:
    """One row per conversation: how many turns it has of its own, the first h of which are exchanged for `shared` turns of the family's head.

    f0 and g0 are the fingerprints of what is shared, f1 and g1 those of its own
    first h turns; u and v move later turns to their new places; f and g belong to all its own turns.
    """
    own = turns.groupBy("conv_id").agg(F.max(F.struct("place", "f", "g")).alias("end"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (TURNS + 1)).cast("long")
    own = own.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"), h.alias("h"), "end")
    first = turns.filter(F.col("place") <= TURNS).select("conv_id", "place", "f", "g")
    at = own.select("conv_id", "h").join(first.withColumnRenamed("place", "h"), ["conv_id", "h"]).select("conv_id", F.col("f").alias("f1"), F.col("g").alias("g1"))
    heads = first.filter(F.col("conv_id") % FAMILY == 0).groupBy(F.col("conv_id").alias("head")).agg(F.sort_array(F.collect_list(F.struct("place", "f", "g"))).alias("prefixes"))
    out = own.join(at, "conv_id", "left").join(heads, "head", "left").withColumn("shared", F.least("h", F.when(F.col("prefixes").isNull(), 0).otherwise(F.size("prefixes"))).cast("long"))
    out = out.withColumn("p", F.get("prefixes", (F.col("shared") - 1).cast("int")))
    # A head that is shorter than h moves the turns behind towards the beginning.
    by = [F.get(F.array(*[F.lit(pow(pow(b, -1, prime), k, prime)).cast("long") for k in range(TURNS + 1)]), (F.col("h") - F.col("shared")).cast("int")) for b in BASES]
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(name)
    return out.select("conv_id", "head", "h", "shared", F.col("end.place").alias("own"), zero("p.f", "f0"), zero("p.g", "g0"), zero("f1", "f1"), zero("g1", "g1"), by[0].alias("u"), by[1].alias("v"), F.col("end.f").alias("f"), F.col("end.g").alias("g"))


def _moved(f: str, g: str, prime: int) -> Column:
    """The label of a prefix whose first turns were exchanged."""
    one = lambda start, end, origin, by: F.pmod(F.col(start) + F.col(by) * F.pmod(F.col(end) - F.col(origin), F.lit(prime)), F.lit(prime))
    return _label(one("f0", f, "f1", "u"), one("g0", g, "g1", "v"))


def _prefixes(turns: DataFrame, convs: DataFrame, prime: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (owner, depth, label, parent, role, text, low, n): those of heads, and those that are each conversation's own.

    A head's turn is one row for all who share it: n is their number, low the smallest of them.
    """
    asked = convs.filter("shared > 0").select("head", "conv_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("shared"))).alias("place"))
    asked = asked.groupBy("head", "place").agg(F.min("conv_id").alias("low"), F.count("*").alias("n"))
    labelled = turns.withColumns({"label": _label(F.col("f"), F.col("g")), "parent": _label(F.col("f_before"), F.col("g_before"))})
    first = labelled.filter((F.col("place") <= TURNS) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("head"), "place", "label", "parent", "role", "text")
    heads = first.join(asked, ["head", "place"]).select(F.col("head").alias("owner"), F.col("place").alias("depth"), "label", "parent", "role", "text", "low", "n")
    moves = convs.select("conv_id", "h", "shared", "f0", "g0", "f1", "g1", "u", "v")
    later = turns.join(moves, "conv_id").filter("place > h")
    later = later.select(
        F.col("conv_id").alias("owner"), (F.col("place") - F.col("h") + F.col("shared")).alias("depth"), _moved("f", "g", prime).alias("label"), _moved("f_before", "g_before", prime).alias("parent"),
        "role", "text", F.col("conv_id").alias("low"), F.lit(1).cast("long").alias("n"),
    )
    return heads, later


def _history(splits: DataFrame, rows: DataFrame, inherited: DataFrame | None) -> DataFrame:
    """(owner, depth, salt, psalt): which splits the prefix of that depth, and the one before it, went through."""
    base = rows.select("owner", "depth").distinct()
    all_ = splits.select("owner", F.col("depth").alias("at"), "nth")
    if inherited is not None:
        all_ = all_.unionByName(inherited)
    met = base.join(all_, "owner").filter("at <= depth").groupBy("owner", "depth").agg(F.sort_array(F.collect_list(F.struct("at", "nth"))).alias("went"))
    told = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["at"], s["nth"])), ",")
    return met.select("owner", "depth", told(F.col("went")).alias("salt"), told(F.filter("went", lambda s: s["at"] < F.col("depth"))).alias("psalt"))


def _split(heads: DataFrame, later: DataFrame, convs: DataFrame, clash: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heads and later turns with salts that keep colliding prefixes apart, and (conv_id, salt) of whole conversations.

    In every group with a clash (depth, label), members that differ from the
    representative, that of the smallest conversation, get the number of their
    variant. The numbers met on the way to a prefix are its salt: prefixes of equal
    labels and salts had equal last turns and equal labels and salts before.
    """
    variant = ["depth", "label", "parent", "role", "text"]
    hit = heads.unionByName(later).join(clash.select("depth", "label"), ["depth", "label"], "left_semi")
    nth = hit.groupBy(*variant).agg(F.min("low").alias("low")).withColumn("nth", F.row_number().over(Window.partitionBy("depth", "label").orderBy("low")) - 1).filter("nth > 0").drop("low")
    nth = cut(nth)
    of_heads, of_later = (cut(x.join(nth, variant).select("owner", "depth", "nth")) for x in (heads, later))
    given = convs.select(F.col("conv_id").alias("owner"), "head", "shared").join(of_heads.select(F.col("owner").alias("head"), F.col("depth").alias("at"), "nth"), "head").filter("at <= shared").select("owner", "at", "nth")
    # Whole conversations count as a row below all their turns.
    ends = convs.select(F.col("conv_id").alias("owner"), (F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("depth"))
    out = []
    for rows, history in ((heads, _history(of_heads, heads, None)), (later, _history(of_later, later, given))):
        out.append(rows.join(history, ["owner", "depth"], "left").fillna("", ["salt", "psalt"]))
    whole = _history(of_later, ends, given).select(F.col("owner").alias("conv_id"), "salt")
    return out[0], out[1], whole


def _variants(heads: DataFrame, later: DataFrame) -> DataFrame:
    """Prefixes by their last turn and what comes before it: chars, low and n of each."""
    rows = heads.unionByName(later)
    found = rows.groupBy("depth", "label", "salt", "parent", "psalt", "role", "text").agg(F.min("low").alias("conv_id"), F.sum("n").alias("n"))
    return cut(found.select("depth", "label", "salt", "parent", "psalt", F.char_length("text").cast("long").alias("chars"), "conv_id", "n"))


def _hashes(ends: DataFrame) -> DataFrame:
    """(depth, label, salt, ends_sha256) of the ids (conv_id) that end at a node, in numerical order.

    Ids are joined by stretches of numbers first, so that what one task hashes is
    a short row for each stretch, read one after the other, whatever their number.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*KEY, F.expr(f"conv_id div {STRETCH}").alias("stretch")).agg(text.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key == at:
                    state.update(b"," + ids.encode())
                else:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*KEY, "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, state.hexdigest())], [*KEY, "ends_sha256"])

    dealt = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "stretch").select(*KEY, "ids")
    return dealt.mapInArrow(run, "depth long, label long, salt string, ends_sha256 string")


def _climb(paths: DataFrame, root: int) -> DataFrame:
    """(conv_id, saved, leaves): sums over each path and all that hang below it; paths (conv_id, up, saved, leaves).

    Every path adds to the one above it, then to that two above, four above and so on, so that rounds grow with the
    logarithm of how deep paths hang. The root's path is asked for by none and gets nothing.
    """
    total = paths.select("conv_id", "saved", "leaves")
    jump = paths.filter(F.col("up") != root).select("conv_id", F.col("up").alias("at"))
    while not jump.isEmpty():
        add = jump.join(total, "conv_id").groupBy(F.col("at").alias("conv_id")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        total = cut(total.join(add, "conv_id", "left").select("conv_id", (F.col("saved") + zero("s")).alias("saved"), (F.col("leaves") + zero("l")).alias("leaves")))
        jump = cut(jump.join(jump.select(F.col("conv_id").alias("at"), F.col("at").alias("next")), "at").select("conv_id", F.col("next").alias("at")))
    return total


def nodes(turns: DataFrame, prime: int = PRIME) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, nulls first, then role and text; null roles and
    texts are empty, rows that repeat are turns of their own. Rows without a
    conv_id belong to no conversation and are left out; ids count as whole numbers.
    Conversations are rebuilt as the module's constants say; one that is left
    without turns is a member of the root alone. An empty table has no root and
    gives no rows. A smaller prime makes collisions likely and the result no other.
    """
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    scanned = _fingerprints(turns, prime)
    convs = cut(_conversations(scanned, prime))
    count, root = convs.agg(F.count("*"), F.min("conv_id")).first()
    if not count:
        return turns.sparkSession.createDataFrame([], schema)
    heads, later = (x.withColumns({"salt": F.lit(""), "psalt": F.lit("")}) for x in _prefixes(scanned, convs, prime))
    found = _variants(heads, later)
    ends = convs.select("conv_id", (F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("depth"), F.when(F.col("own") > F.col("h"), _moved("f", "g", prime)).otherwise(_label(F.col("f0"), F.col("g0"))).alias("label"))
    clash = cut(found.groupBy("depth", "label").agg(F.count("*").alias("variants")).filter("variants > 1"))
    if clash.isEmpty():
        ends = ends.withColumn("salt", F.lit(""))
    else:
        heads, later, whole = _split(heads.drop("salt", "psalt"), later.drop("salt", "psalt"), convs, clash)
        found = _variants(heads, later)
        ends = ends.join(whole, "conv_id", "left").fillna("", ["salt"])

    top = turns.sparkSession.createDataFrame([(0, 0, "", None, None, 0, root, count)], "depth long, label long, salt string, parent long, psalt string, chars long, conv_id long, n long")
    found = found.unionByName(top)
    children = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("label"), F.col("psalt").alias("salt")).agg(F.count("*").alias("n_children"))
    known = found.join(children, KEY, "left").join(_hashes(ends), KEY, "left")
    leaf = F.col("n_children").isNull().cast("long")
    known = known.select(*KEY, "parent", "psalt", "conv_id", "n", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), leaf.alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    known = cut(known)

    # The uppermost node of every path, and the node it hangs on: the root for all of depth 1.
    paths = known.groupBy("conv_id").agg(F.min(F.struct("depth", "parent", "psalt")).alias("top"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    paths = cut(paths.select("conv_id", F.col("top.depth").alias("top"), F.col("top.parent").alias("label"), F.col("top.psalt").alias("salt"), "saved", "leaves").filter("top > 0"))
    above = paths.filter("top > 1").withColumn("depth", F.col("top") - 1).join(known.select(*KEY, F.col("conv_id").alias("up")), KEY).select("conv_id", "top", "up", "saved", "leaves")
    paths = cut(above.unionByName(paths.filter("top = 1").select("conv_id", "top", F.lit(root).cast("long").alias("up"), "saved", "leaves")))
    total = _climb(paths, root)
    hanging = paths.select("conv_id", "up", (F.col("top") - 1).alias("depth")).join(total, "conv_id").groupBy(F.col("up").alias("conv_id"), "depth").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = known.join(hanging, ["conv_id", "depth"], "left").join(paths.select("conv_id", F.col("top").alias("depth"), "up"), ["conv_id", "depth"], "left")
    rows = rows.withColumns({"saved": F.col("saved") + zero("s"), "leaves": F.col("leaves") + zero("l"), "parent_conv_id": F.when(F.col("depth") > 0, F.coalesce("up", "conv_id"))})
    # What lies below a node on its own path comes before it from the path's end.
    summed = scan(rows, "conv_id", [F.col("depth").desc()], {"saved": 1, "leaves": 1}, ["depth", "parent_conv_id", "n", "n_children", "ends_sha256"])
    return summed.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")


#: Prefixes as text, each turn with the lengths of its parts; subtrees by the members of their nodes. The checksum of an id is taken bit by bit.
ORACLE_SQL = """
WITH RECURSIVE t AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS x FROM t
  UNION ALL
  SELECT conv_id, s, i + 1, xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(x, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE x END AS y FROM bits WHERE i < 8 * length(s))),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS head, xor(x, 4294967295) % 6 AS h FROM bits WHERE i = 8 * length(s)),
r AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS d, role, text FROM (
    SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.head AND t.place <= c.h
    UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h)),
p AS MATERIALIZED (
  SELECT conv_id, d, length(text) AS chars, max(d) OVER (PARTITION BY conv_id) AS len,
         md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r
  UNION ALL SELECT c.conv_id, 0, 0, coalesce(m, 0), '' FROM c LEFT JOIN (SELECT conv_id, max(d) AS m FROM r GROUP BY 1) USING (conv_id)),
n AS MATERIALIZED (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = len), '')) AS ends
  FROM p GROUP BY k, d),
u AS MATERIALIZED (SELECT n.k, n.d, q.k AS up FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.d = n.d - 1),
ch AS MATERIALIZED (SELECT up AS k, d - 1 AS d, count(*) AS m FROM u WHERE d > 0 GROUP BY ALL),
a AS (SELECT q.k, q.d, CAST(sum((n.n - 1) * n.chars) AS BIGINT) AS saved, count(*) FILTER (WHERE ch.k IS NULL) AS leaves
      FROM n LEFT JOIN ch ON ch.k = n.k AND ch.d = n.d JOIN p q ON q.conv_id = n.conv_id AND q.d <= n.d GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(ch.m, 0) AS n_children, a.leaves AS n_leaves, a.saved AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN u ON u.k = n.k AND u.d = n.d LEFT JOIN n up ON up.k = u.up AND up.d = n.d - 1 LEFT JOIN ch ON ch.k = n.k AND ch.d = n.d JOIN a ON a.k = n.k AND a.d = n.d
"""
