"""Reply threads: edges, roots, foreign responses and pre-order listings from (id, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.operators.clusters import _counted, _recovery_point


def reply_edges(mails: DataFrame) -> DataFrame:
    """(parent, id) from (id, replies): every id a mail answers to but its own; a mail without one has a NULL parent.

    Mails of one id count once, with the ids that any of them answers to.
    """
    one = mails.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("replies", F.array().cast("array<string>"))))).alias("replies"))
    return one.select(F.explode_outer(F.array_remove("replies", F.col("id"))).alias("parent"), "id")


def parents(mails: DataFrame) -> DataFrame:
    """(id, parent) from (id, references): the first known id of the references, and where several are named but none is known, the smallest of them.

    A mail that names no id, or a single unknown one, has no parent. `references` is in the order in which they are tried.
    """
    known = mails.select(F.col("id").alias("ref")).distinct().withColumn("known", F.lit(True))
    asked = mails.select("id", F.posexplode(F.array_remove("references", F.col("id"))).alias("pos", "ref"))
    found = asked.join(known, "ref", "left").groupBy("id").agg(
        F.min(F.when(F.col("known"), F.struct("pos", "ref"))).alias("near"), F.count_distinct("ref").alias("n"), F.min("ref").alias("low")
    )
    parent = F.coalesce(F.col("near.ref"), F.when(F.col("n") > 1, F.col("low")))
    return mails.select("id").distinct().join(found, "id", "left").select("id", parent.alias("parent"))


def _up(mails: DataFrame) -> DataFrame:
    """(id, parent) of known mails, a parent that is known too or NULL; cycles are cut at their smallest id, of several parents the smallest counts."""
    known = mails.select(F.col("id").alias("parent")).distinct()
    step = mails.filter("parent is not null and parent <> id").join(known, "parent", "left_semi").groupBy("id").agg(F.min("parent").alias("parent"))
    up = _recovery_point(mails.select("id").distinct().join(step, "id", "left"))
    # Pointer doubling with the smallest id on the way: who never comes to a root hangs below a cycle, and the smallest id of that is on every way round it.
    jump = up.select("id", F.col("parent").alias("at"), F.least("id", "parent").alias("low"), F.col("parent").isNull().alias("done"))
    n, far, left = up.count(), 1, 1
    while far <= n and left:
        there = jump.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("low").alias("low2"))
        jump, left = _counted(jump.join(there, "at", "left").select("id", F.col("next").alias("at"), F.least("low", "low2").alias("low"), F.col("next").isNull().alias("done")), ~F.col("done"))
        far *= 2
    if far <= n:
        return up
    # `at` of those is on the cycle, as they went further than there are mails; its `low` is the cycle's smallest id.
    ends = jump.filter("not done").select(F.col("at").alias("id")).distinct().join(jump.select("id", "low"), "id").select(F.col("low").alias("id")).distinct().withColumn("cut", F.lit(True))
    return _recovery_point(up.join(ends, "id", "left").select("id", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent")))


def roots(mails: DataFrame) -> DataFrame:
    """(id, root, depth): the topmost known mail and the steps to it; rounds grow with the logarithm of the depth."""
    return _roots(_up(mails))


def _roots(up: DataFrame) -> DataFrame:
    """Pointer doubling: one row a mail in every round."""
    jump = up.select("id", F.coalesce("parent", "id").alias("root"), F.col("parent").isNotNull().cast("long").alias("depth"))
    moved = 1
    while moved:
        there = jump.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        jump, moved = _counted(jump.join(there, "root").select("id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), "more"), F.col("more") > 0)
        jump = jump.drop("more")
    return jump.select("id", "root", F.col("depth").cast("int").alias("depth"))


def expand(mails: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, depth) of all mails below the given ones (start), themselves included at 0."""
    up = _up(mails)
    size = _sizes(up)
    order = _preorder(up, size)
    last = order.join(size, "id").withColumn("end", F.col("position") + F.col("size") - 1)
    top = starts.select(F.col("start").alias("id")).distinct().join(last, "id").select(F.col("id").alias("start"), "root", F.col("position").alias("from"), "end", F.col("depth").alias("above"))
    met = order.join(top, "root").filter((F.col("position") >= F.col("from")) & (F.col("position") <= F.col("end")))
    return met.select("start", "id", (F.col("depth") - F.col("above")).alias("depth"))


def preorder(mails: DataFrame) -> DataFrame:
    """(id, parent, root, position): mails of a thread in depth-first order, children by id; rows as many as mails, however deep they lie."""
    up = _up(mails)
    told = mails.groupBy("id").agg(F.min("parent").alias("parent"))
    return _preorder(up, _sizes(up)).join(told, "id").select("id", "parent", "root", "position")


def _preorder(up: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, root, position, depth) by a sum along the way to the root.

    A mail comes one place after its parent, and after all below its elder siblings. So its place is the sum, over
    itself and all above it, of one and what the siblings before it hold; sums on the way up are doubled like pointers, two numbers a mail.
    """
    placed = up.join(sizes, "id")
    elder = F.coalesce(F.sum("size").over(Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = placed.filter("parent is not null").select("id", F.col("parent").alias("at"), (elder + 1).alias("place"), F.lit(1).cast("long").alias("depth"))
    jump = below.unionByName(placed.filter("parent is null").select("id", F.col("id").alias("at"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("depth")))
    moved = 1
    while moved:
        there = jump.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("place").alias("more"), F.col("depth").alias("steps"))
        jump, moved = _counted(jump.join(there, "at").select("id", F.col("next").alias("at"), (F.col("place") + F.col("more")).alias("place"), (F.col("depth") + F.col("steps")).alias("depth"), "steps"), F.col("steps") > 0)
        jump = jump.drop("steps")
    return jump.select("id", F.col("at").alias("root"), (F.col("place") + 1).alias("position"), F.col("depth").cast("int").alias("depth"))


def sizes(mails: DataFrame) -> DataFrame:
    """(id, size): mails at or below each one."""
    return _sizes(_up(mails))


def _sizes(up: DataFrame) -> DataFrame:
    """Sums doubled like the pointers: every mail adds to the one above it, then to that two above, four above and so on."""
    total = up.select("id", F.lit(1).cast("long").alias("size"))
    jump, left = _counted(up.filter("parent is not null").select("id", F.col("parent").alias("at")))
    while left:
        add = jump.join(total, "id").groupBy(F.col("at").alias("id")).agg(F.sum("size").alias("more"))
        total = _recovery_point(total.join(add, "id", "left").select("id", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        jump, left = _counted(jump.alias("a").join(jump.alias("b"), F.col("a.at") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.at").alias("at")))
    return total


def foreign_response(mails: DataFrame) -> DataFrame:
    """(id, foreign_response): somebody else wrote below the mail.

    A subtree is a range of the pre-order, and it holds another author where it holds
    more mails than those of the mail's own author in that range.
    """
    up = _up(mails)
    size = _sizes(up)
    order = _preorder(up, size).join(mails.groupBy("id").agg(F.min("author").alias("author")), "id")
    span = _recovery_point(order.join(size, "id").select("id", "root", "author", "position", (F.col("position") + F.col("size") - 1).alias("end"), "size"))
    # Running counts of an author's mails, looked up at the range's end.
    marks = span.select("root", "author", F.col("position").alias("at"), F.lit(1).alias("own"), F.lit(None).cast("string").alias("id"))
    asks = span.select("root", "author", F.col("end").alias("at"), F.lit(0).alias("own"), "id")
    upto = F.sum("own").over(Window.partitionBy("root", "author").orderBy("at", F.desc("own")).rowsBetween(Window.unboundedPreceding, 0))
    at_end = marks.unionByName(asks).withColumn("upto", upto).filter("id is not null").select("id", "upto")
    rank = F.row_number().over(Window.partitionBy("root", "author").orderBy("position"))
    own = span.withColumn("rank", rank).join(at_end, "id").select("id", (F.col("size") > F.col("upto") - F.col("rank") + 1).alias("foreign_response"))
    return own


def refresh_threads(known: DataFrame, present: DataFrame) -> DataFrame:
    """Reply edges (parent, id) with those of the mails (id, replies) that have none yet."""
    new = present.join(known.select("id").distinct(), "id", "left_anti")
    return known.select("parent", "id").unionByName(reply_edges(new))
