"""Files, sections and the graph between sections: typed pattern joins, hop distances, communities and their meta graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import text as tx
from patchloom.operators.clusters import _counted, _recovery_point

#: Steps of a walk by which sections of a community are told from others.
STEPS = 4


def valid_patterns(patterns: DataFrame, tree: DataFrame) -> DataFrame:
    """Patterns (section, kind, pattern) with `form`: exact, prefix, glob or name; F and X entries without a wildcard must be in the tree.

    tree: (path) of files. An entry that is a file matches it alone, one that is a
    folder, written with or without the slash at the end, all below, any other none.
    """
    wild = F.col("pattern").rlike(r"[*?]")
    folders = tree.select(F.explode(F.expr("transform(sequence(1, size(split(path, '/')) - 1), i -> concat_ws('/', slice(split(path, '/'), 1, i)))")).alias("bare")).distinct()
    p = patterns.withColumn("bare", F.regexp_replace("pattern", "/$", ""))
    named = p.filter("kind = 'N'").withColumn("form", F.lit("name"))
    globs = p.filter((F.col("kind") != "N") & wild).withColumn("form", F.lit("glob"))
    plain = p.filter((F.col("kind") != "N") & ~wild)
    exact = plain.filter("not endswith(pattern, '/')").join(tree.select(F.col("path").alias("bare")).distinct(), "bare", "left_semi").withColumn("form", F.lit("exact"))
    prefix = plain.join(folders, "bare", "left_semi").withColumn("form", F.lit("prefix"))
    cols = ["section", "kind", "pattern", "bare", "form"]
    return named.select(cols).unionByName(globs.select(cols)).unionByName(exact.select(cols)).unionByName(prefix.select(cols))


def _by_globs(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """(path, section, kind) of wildcard entries: components of patterns are a trie, walked a level at a time by all paths.

    Wildcards stay within a component. At every node each different component is tested once
    against the wildcards that go on from there, so patterns meet what they share once, not every path.
    """
    parts = F.split(F.regexp_replace("pattern", "/$", ""), "/")
    g = globs.select("section", "kind", parts.alias("parts"), F.endswith("pattern", F.lit("/")).alias("below")).withColumn("node", F.concat(F.lit("/"), F.array_join("parts", "/")))
    edges = g.select("parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("i"))
    name = lambda n: F.when(n == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), n), "/")))
    edges = edges.select(name(F.col("i")).alias("node"), F.get("parts", F.col("i")).alias("part"), name(F.col("i") + 1).alias("child")).distinct()
    edges = _recovery_point(edges.withColumn("wild", F.col("part").rlike(r"[*?]")))
    deepest = g.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0]
    at, hits = paths.select("path", F.split("path", "/").alias("parts"), F.lit("").alias("node")), []
    for level in range(deepest):
        at = at.filter(F.size("parts") > level).withColumn("part", F.get("parts", F.lit(level)))
        seen = at.select("node", "part").distinct()
        same = seen.join(edges.filter("not wild").select("node", "part", "child"), ["node", "part"])
        like = seen.join(edges.filter("wild").select("node", tx.glob_to_regex(F.col("part")).alias("r"), "child"), "node").filter("part rlike r").select("node", "part", "child")
        at = _recovery_point(at.join(same.unionByName(like), ["node", "part"]).select("path", "parts", F.col("child").alias("node")))
        done = at.join(g.select("node", "section", "kind", "below"), "node").filter(F.when(F.col("below"), F.size("parts") > level + 1).otherwise(F.size("parts") == level + 1))
        hits.append(done.select("path", "section", "kind"))
    return reduce(DataFrame.unionByName, hits) if hits else paths.select("path", F.lit("").alias("section"), F.lit("").alias("kind")).filter(F.lit(False))


def _by_names(paths: DataFrame, names: DataFrame) -> DataFrame:
    """(path, section, kind) of name patterns: those with plain letters meet the paths that have the rarest three of them in a row.

    Patterns without three plain characters in a row, or with choices, are few; every path is tested against the list of them.
    """
    p = names.select("section", "kind", F.regexp_replace("pattern", r"\*+$", "").alias("r"))
    runs = lambda c, n: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))), lambda x: F.length(x) == n)
    plain = F.when(F.col("r").rlike(r"^[\w/ -]{3,}$"), runs(F.col("r"), 3)).otherwise(F.array().cast("array<string>"))
    p = _recovery_point(p.withColumn("runs", plain))
    have = paths.select("path", F.explode(F.array_distinct(runs(F.col("path"), 3))).alias("run"))
    asked = p.select("r", F.explode("runs").alias("run")).distinct()
    often = have.join(asked.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "run").groupBy("r").agg(F.min_by("run", F.struct("n", "run")).alias("run"), F.count("*").alias("found"))
    met = have.join(rarest, "run").select("path", "r").filter(F.contains("path", F.col("r")))
    others = p.filter("size(runs) = 0").agg(F.collect_set("r").alias("l")).first()["l"]
    if others:
        every = paths.select("path", F.explode(F.filter(F.array(*[F.lit(x) for x in others]), lambda r: F.call_function("rlike", F.col("path"), r))).alias("r"))
        met = met.unionByName(every)
    return met.join(p, "r").select("path", "section", "kind")


def files_of_sections(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, section): an X entry excludes a file; else an F entry takes it, else an N entry.

    patterns as `valid_patterns` gives them. Exact entries and folders are equal
    joins on the path and on the folders above it, wildcards are walked component by
    component, and name patterns meet paths by letters in a row.
    """
    paths = _recovery_point(files.select("path").distinct())
    above = paths.select("path", F.explode(F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), i -> concat_ws('/', slice(split(path, '/'), 1, i)))")).alias("bare"))
    p = _recovery_point(patterns.select("section", "kind", "bare", "pattern", "form").distinct())
    exact = paths.withColumn("bare", F.col("path")).join(p.filter("form = 'exact'"), "bare").select("path", "section", "kind")
    below = above.filter("bare <> path").join(p.filter("form = 'prefix'"), "bare").select("path", "section", "kind")
    hits = exact.unionByName(below).unionByName(_by_globs(paths, p.filter("form = 'glob'"))).unionByName(_by_names(paths, p.filter("form = 'name'")))
    g = hits.groupBy("path", "section").agg(F.count_if(F.col("kind") == "X").alias("x"), F.count_if(F.col("kind") != "X").alias("hit"))
    return g.filter("x = 0 and hit > 0").select("path", "section")


def hops(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, hops): fewest edges between any section a and any section b of the pairs (key, a, b); keys without a path are left out.

    Breadth first from all sections that are asked for at once, until all pairs have met or nothing new is
    reached. What is next to a front is in it, in the one before or new, so no more than two fronts are looked at in a round.
    """
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    both = _recovery_point(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct())
    asked, left = _counted(pairs.select(F.col("a").alias("source"), F.col("b").alias("at")).distinct().withColumn("asked", F.lit(True)))
    marked = lambda reached, step: reached.join(asked, ["source", "at"], "left").select("source", "at", F.coalesce("asked", F.lit(False)).alias("asked"), F.lit(step).alias("hops"))
    front, met = _counted(marked(asked.select("source", F.col("source").alias("at")).distinct(), 0), F.col("asked"))
    fronts, step = [front], 0
    while met < left:
        step += 1
        reached = front.join(both, F.col("at") == F.col("u")).select("source", F.col("v").alias("at")).distinct()
        for known in fronts[-2:]:
            reached = reached.join(known, ["source", "at"], "left_anti")
        front, hit = _counted(marked(reached, step), F.col("asked"))
        if not hit and front.isEmpty():
            break
        fronts.append(front)
        met += hit
    found = reduce(DataFrame.unionByName, fronts).filter("asked").select(F.col("source").alias("a"), F.col("at").alias("b"), "hops")
    return pairs.join(found, ["a", "b"]).groupBy("key").agg(F.min("hops").alias("hops"))


def communities(edges: DataFrame, in_order: bool = False) -> DataFrame:
    """(section, group) by random walks of STEPS steps: sections are merged with the neighbour whose walks are most alike.

    In every round each group looks at the groups it has edges with, by the squared
    distance of their mean walk probabilities, weighted by both sizes; pairs that
    choose each other are merged. Of all rounds the one with the highest modularity is
    given. group is its smallest section; edges (src, dst, lines) of weight 0 and loops do not count.

    With in_order the result is that of one merge at a time, the nearest pair first,
    equal ones by name, cut after the merge with the highest modularity. It takes up to a round
    for each merge, so it is for graphs of some hundred sections.
    """
    e = edges.filter("src <> dst and lines > 0").groupBy(F.least("src", "dst").alias("s"), F.greatest("src", "dst").alias("t")).agg(F.sum("lines").cast("double").alias("w"))
    e = _recovery_point(e)
    both = e.select(F.col("s").alias("u"), F.col("t").alias("v"), "w").unionByName(e.select(F.col("t").alias("u"), F.col("s").alias("v"), "w"))
    # A walk may also stay, by the mean weight of a section's edges.
    stay = both.groupBy("u").agg(F.avg("w").alias("w")).select("u", F.col("u").alias("v"), "w")
    degree = both.unionByName(stay).groupBy("u").agg(F.sum("w").alias("d"))
    move = _recovery_point(both.unionByName(stay).join(degree, "u").select("u", "v", (F.col("w") / F.col("d")).alias("p")))
    walk = move
    for _ in range(STEPS - 1):
        walk = _recovery_point(walk.alias("a").join(move.alias("b"), F.col("a.v") == F.col("b.u")).groupBy(F.col("a.u").alias("u"), F.col("b.v").alias("v")).agg(F.sum(F.col("a.p") * F.col("b.p")).alias("p")))
    walk = _recovery_point(walk.join(degree.select(F.col("u").alias("v"), "d"), "v").select("u", "v", (F.col("p") / F.sqrt("d")).alias("x")))
    total = e.agg(F.sum("w")).first()[0] or 0.0
    label = _recovery_point(degree.select(F.col("u").alias("section"), F.col("u").alias("group")))
    if in_order and total:
        return _merged_in_order(label, both, walk, total)
    best, best_q = label, -1.0
    # The two groups that are nearest of all choose each other, so every round merges some.
    while True:
        named = label.select(F.col("section").alias("u"), F.col("group").alias("g"))
        links = both.join(named, "u").join(named.select(F.col("u").alias("v"), F.col("g").alias("h")), "v").groupBy("g", "h").agg(F.sum("w").alias("w"))
        links = _recovery_point(links)
        q = links.groupBy("g").agg(F.sum(F.when(F.col("g") == F.col("h"), F.col("w")).otherwise(0.0)).alias("own"), F.sum("w").alias("all")).agg(F.sum(F.col("own") / (2 * total) - F.pow(F.col("all") / (2 * total), F.lit(2)))).first()[0] if total else None
        if q is not None and q > best_q:
            best, best_q = label, q
        near = links.filter("g <> h").select("g", "h")
        if near.isEmpty():
            break
        size = label.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("n"))
        mean = _recovery_point(walk.join(named, "u").join(size, "g").groupBy("g", "v").agg((F.sum("x") / F.first("n")).alias("x")))
        a, b = near.join(mean, "g").select("g", "h", "v", "x"), near.join(mean.select(F.col("g").alias("h"), "v", (-F.col("x")).alias("x")), "h").select("g", "h", "v", "x")
        gap = a.unionByName(b).groupBy("g", "h", "v").agg(F.sum("x").alias("x")).groupBy("g", "h").agg(F.sum(F.col("x") * F.col("x")).alias("r"))
        cost = gap.join(size, "g").join(size.select(F.col("g").alias("h"), F.col("n").alias("m")), "h").withColumn("cost", F.round(F.col("r") * F.col("n") * F.col("m") / (F.col("n") + F.col("m")), 12))
        choice = _recovery_point(cost.groupBy("g").agg(F.min(F.struct("cost", F.least("g", "h").alias("lo"), F.greatest("g", "h").alias("hi"), "h")).alias("m")).select("g", F.col("m.h").alias("h")))
        mutual = choice.alias("a").join(choice.alias("b"), (F.col("a.h") == F.col("b.g")) & (F.col("a.g") == F.col("b.h"))).filter("a.g > b.g").select(F.col("a.g").alias("group"), F.col("b.g").alias("into"))
        label = _recovery_point(label.join(mutual, "group", "left").select("section", F.coalesce("into", "group").alias("group")))
    first = best.groupBy("group").agg(F.min("section").alias("name"))
    return best.join(first, "group").select("section", F.col("name").alias("group"))


def _merged_in_order(label: DataFrame, both: DataFrame, walk: DataFrame, total: float) -> DataFrame:
    """`communities` one merge at a time.

    A round does as many merges as surely come next: pairs that choose each other, up to the first that
    another pair, or one that they make, may precede. The modularity of the
    merges of a round is summed up in one task, a few numbers each.
    """
    pairs, labels, merges = _merge_costs(label, both, walk), [label], []
    while not pairs.isEmpty():
        # Pairs that choose each other; the nearest of all is among them.
        each = pairs.unionByName(pairs.select("key", F.col("hi").alias("lo"), F.col("lo").alias("hi"), "w"))
        choice = _recovery_point(each.groupBy("lo").agg(F.min("key").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n = 2").select("key"))
        batch = pairs.join(choice, "key", "left_semi")
        label = labels[-1]
        after = label.join(batch.select(F.col("hi").alias("group"), F.col("lo").alias("into")), "group", "left").select("section", F.coalesce("into", "group").alias("group"))
        ends = batch.select(F.col("lo").alias("g"), "key").unionByName(batch.select(F.col("hi").alias("g"), "key"))
        # What may come before a pair of the batch: pairs apart from all of them, and pairs that their merges make, with groups as they were or merged.
        apart = pairs.join(ends.select(F.col("g").alias("lo")), "lo", "left_anti").join(ends.select(F.col("g").alias("hi")), "hi", "left_anti")
        grown = batch.select(F.col("lo").alias("g"))
        made = _merge_costs(after, both, walk, grown).unionByName(_merge_costs(label, both, walk, grown, after))
        bound = apart.select("key").unionByName(made.select("key")).agg(F.min("key").alias("k")).crossJoin(choice.agg(F.min("key").alias("first")))
        done = _recovery_point(batch.crossJoin(F.broadcast(bound)).filter("k is null or key < k or key = first").select("key", "lo", "hi", "w"))
        label = _recovery_point(label.join(done.select(F.col("hi").alias("group"), F.col("lo").alias("into")), "group", "left").select("section", F.coalesce("into", "group").alias("group")))
        weight = both.join(labels[-1].select(F.col("section").alias("u"), "group"), "u").groupBy("group").agg(F.sum("w").alias("a"))
        gain = done.join(weight.select(F.col("group").alias("lo"), "a"), "lo").join(weight.select(F.col("group").alias("hi"), F.col("a").alias("b")), "hi")
        merges.append(gain.select(F.lit(len(merges)).alias("round"), "key", "lo", "hi", (F.col("w") / total - F.col("a") * F.col("b") / (2 * total * total)).alias("gain")))
        labels.append(label)
        # Pairs of groups that stay as they were keep their cost.
        gone = _recovery_point(done.select(F.col("lo").alias("g")).unionByName(done.select(F.col("hi").alias("g"))))
        kept = pairs.join(gone.select(F.col("g").alias("lo")), "lo", "left_anti").join(gone.select(F.col("g").alias("hi")), "hi", "left_anti")
        pairs = _recovery_point(kept.unionByName(_merge_costs(label, both, walk, done.select(F.col("lo").alias("g")))))
    tree = _recovery_point(reduce(DataFrame.unionByName, merges))
    before = tree.groupBy("round").agg(F.sum("gain").alias("g")).select("round", (F.sum("g").over(Window.orderBy("round")) - F.col("g")).alias("base"))
    there = tree.join(F.broadcast(before), "round").withColumn("q", F.round(F.col("base") + F.sum("gain").over(Window.partitionBy("round").orderBy("key")), 12))
    cut = there.orderBy(F.desc("q"), "round", "key").select("round", "key", "q").first()
    if cut.q <= 0:
        return labels[0]
    key = F.struct(*[F.lit(x) for x in cut.key]).cast(tree.schema["key"].dataType)
    last = tree.filter((F.col("round") == cut["round"]) & (F.col("key") <= key)).select(F.col("hi").alias("group"), F.col("lo").alias("into"))
    return labels[cut["round"]].join(last, "group", "left").select("section", F.coalesce("into", "group").alias("group"))


def _merge_costs(label: DataFrame, both: DataFrame, walk: DataFrame, only: DataFrame | None = None, other: DataFrame | None = None) -> DataFrame:
    """(key, lo, hi, w) of neighbouring groups: key (cost, lo, hi) is the growth of the walks' variance if they merge, w the weight between them.

    `only` (g) gives the pairs that have one of these groups. With `other`, a second labelling of which the
    groups of `only` are taken, pairs of a group of `only` with what are groups of `label` outside it.
    """
    named = lambda rows: rows.select(F.col("section").alias("u"), F.col("group").alias("g"))
    left, right = named(label if other is None else other), named(label)
    if only is not None:
        left = left.join(only, "g", "left_semi")
    links = both.join(left, "u").join(right.select(F.col("u").alias("v"), F.col("g").alias("h")), "v").groupBy("g", "h").agg(F.sum("w").alias("w"))
    # A group that is grown holds what it grew from.
    held = left.join(right.withColumnRenamed("g", "h"), "u").select("g", "h").distinct()
    links = links.join(held, ["g", "h"], "left_anti")

    def means(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        rows = rows.join(wanted, "g", "left_semi")
        size = rows.groupBy("g").agg(F.count("*").alias("n"))
        return walk.join(rows, "u").groupBy("g", "v").agg(F.sum("x").alias("x")).join(size, "g").select("g", "v", (F.col("x") / F.col("n")).alias("x"), "n")

    links = _recovery_point(links)
    m, k = means(left, links.select("g").distinct()), means(right, links.select(F.col("h").alias("g")).distinct()).withColumnRenamed("g", "h")
    a = links.join(m, "g").select("g", "h", "w", "v", "x", "n", F.lit(0).cast("long").alias("m"))
    b = links.join(k, "h").select("g", "h", "w", "v", (-F.col("x")).alias("x"), F.lit(0).cast("long").alias("n"), F.col("n").alias("m"))
    gap = a.unionByName(b).groupBy("g", "h", "w", "v").agg(F.sum("x").alias("x"), F.max("n").alias("n"), F.max("m").alias("m")).groupBy("g", "h", "w").agg(F.sum(F.col("x") * F.col("x")).alias("r"), F.max("n").alias("n"), F.max("m").alias("m"))
    lo, hi = F.least("g", "h"), F.greatest("g", "h")
    cost = gap.select(F.round(F.col("r") * F.col("n") * F.col("m") / (F.col("n") + F.col("m")), 12).alias("cost"), lo.alias("lo"), hi.alias("hi"), "w")
    return _recovery_point(cost.groupBy("lo", "hi").agg(F.min("cost").alias("cost"), F.min("w").alias("w")).select(F.struct("cost", "lo", "hi").alias("key"), "lo", "hi", "w"))


def group_representatives(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, representative): the largest section (section, size) of each community, of equal ones the first by name."""
    r = Window.partitionBy("group").orderBy(F.desc("size"), "section")
    return groups.join(sizes, "section", "left").withColumn("size", F.coalesce("size", F.lit(0))).withColumn("n", F.row_number().over(r)).filter("n = 1").select("group", F.col("section").alias("representative"))


def group_matrix(files: DataFrame, groups: DataFrame) -> DataFrame:
    """(i, j, lines): lines of the files (file, section, lines) that communities i and j share; both orders, and i = j for all lines of one."""
    f = files.join(groups, "section").select("file", "group", "lines").distinct()
    a, b = f.alias("a"), f.alias("b")
    met = a.join(b, F.col("a.file") == F.col("b.file"))
    return met.groupBy(F.col("a.group").alias("i"), F.col("b.group").alias("j")).agg(F.sum("a.lines").alias("lines"))


def meta_graph(matrix: DataFrame) -> DataFrame:
    """Edges between different communities that share lines."""
    return matrix.filter("i <> j and lines <> 0")


def with_lonely(graph: DataFrame, sections: DataFrame) -> DataFrame:
    """The section graph with a loop of weight 0 for sections (section) that have no file."""
    there = graph.filter("src = dst").select(F.col("src").alias("section"))
    zero = sections.select("section").distinct().join(there, "section", "left_anti").select(F.col("section").alias("src"), F.col("section").alias("dst"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("files"))
    return graph.select("src", "dst", "lines", "files").unionByName(zero)
