"""All queries of the analytics engine by name, and the SQL that must give the same rows.

The tables stand in for patches, mails and stacks: documents are patches, orders
and lineitem the way of changes into releases, conversations are threads, part
and supplier are files and sections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.functions import similarity as sim
from patchloom.functions import text as tx
from patchloom.operators import clusters as cl
from patchloom.operators import reports as rp
from patchloom.operators import sections as se
from patchloom.operators import threads as th

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _mails(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select(F.concat(F.lit("<"), "conv_id", F.lit("."), "turn", F.lit("@x>")).alias("id"), "conv_id", "turn", F.when(F.col("turn") > 0, F.concat(F.lit("<"), "conv_id", F.lit("."), F.col("turn") - 1, F.lit("@x>"))).alias("parent"), F.col("role").alias("author"))


_MAILS = "mails AS (SELECT '<' || conv_id || '.' || turn || '@x>' AS id, conv_id, turn, CASE WHEN turn > 0 THEN '<' || conv_id || '.' || (turn - 1) || '@x>' END AS parent, role AS author FROM conversations)"


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Patches in classes of equal text; upstream where the label says so."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.encode("text", "UTF-8")).alias("h"), "source")
    first = docs.groupBy("h").agg(F.min("id").alias("cluster_id"))
    up = _t(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("up"))
    return docs.join(first, "h").join(up, "id", "left").select("id", "cluster_id", F.coalesce("up", F.lit(False)).alias("is_upstream"), "source")


_MEMBERS = "members AS (SELECT d.doc_id AS id, min(d.doc_id) OVER (PARTITION BY d.text) AS cluster_id, coalesce(l.quality = 1, false) AS is_upstream, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(tx.week(F.col("o_orderdate")).alias("week"), F.col("o_orderpriority").alias("list"), F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "O", True).alias("ignored"), F.col("o_orderstatus").alias("type"), F.year("o_orderdate").alias("year"))


_WEEKLY = "weekly AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderpriority AS list, CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN true END AS ignored, o_orderstatus AS type, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)"


def _stacks(spark: SparkSession, d: str) -> DataFrame:
    """Commits in ordered stacks: a quarter is a stack, an order a commit, a customer its group."""
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("grp"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("ord"), F.to_date("o_orderdate").alias("day"))


_STACKS = "stacks AS (SELECT o_orderkey AS commit, o_custkey AS grp, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS ord, CAST(o_orderdate AS DATE) AS day FROM orders)"


def _both_sides(spark: SparkSession, d: str) -> DataFrame:
    down = _t(spark, d, "orders").select(F.col("o_orderkey").alias("cluster_id"), F.col("o_orderdate").cast("timestamp").alias("down"))
    up = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_linenumber").alias("id"), F.col("l_shipdate").cast("timestamp").alias("up"))
    return down.join(up.repartition(_tasks(spark, d, "lineitem"), "cluster_id"), "cluster_id")


def _tasks(spark: SparkSession, d: str, name: str, rows: int = 250_000) -> int:
    """Tasks for a table's rows, about `rows` each, and no fewer than shuffles have; the table's files know their number of rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_t(spark, d, name).count() // rows))


# ---------------------------------------------------------------- parsing and projections


@query("SELECT doc_id, CASE WHEN regexp_matches(s, '^\\[.*?\\]:? ?(.*)') THEN regexp_extract(s, '^\\[.*?\\]:? ?(.*)', 1) ELSE s END AS subject FROM (SELECT doc_id, '[PATCH v' || doc_id % 4 || '] ' || split_part(text, chr(10), 1) AS s FROM documents)")
def p3_subject_strip(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit("[PATCH v"), F.col("doc_id") % 4, F.lit("] "), F.split_part("text", F.lit("\n"), F.lit(1)))
    return _t(spark, d, "documents").select("doc_id", tx.strip_subject(s).alias("subject"))


@query("SELECT doc_id, contains(lower(text), 'revert') AS is_revert FROM documents")
def p7_is_revert(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", tx.is_revert(F.col("text")).alias("is_revert"))


@query(f"WITH {_MAILS} SELECT id, list_distinct(regexp_extract_all(coalesce(parent, '') || ' ' || id, '(<\\S+>)', 1))[1] AS first_id, CAST(len(list_distinct(regexp_extract_all(coalesce(parent, '') || ' ' || id || ' ' || id, '(<\\S+>)', 1))) AS INTEGER) AS n_ids FROM mails WHERE turn = 0")
def p14_message_ids(spark: SparkSession, d: str) -> DataFrame:
    header = F.concat_ws(" ", F.coalesce("parent", F.lit("")), "id", "id")
    return _mails(spark, d).filter("turn = 0").select("id", tx.message_ids(header)[0].alias("first_id"), F.size(tx.message_ids(header)).alias("n_ids"))


@query("SELECT DISTINCT p_type, '^' || replace(replace(p_type, ' ', '/'), 'X', 'X') || '/([^/]*)\\.([^/])$' AS regex FROM part")
def p20_glob_regex(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_type", tx.glob_to_regex(F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/*.?"))).alias("regex")).distinct()


@query("SELECT s_suppkey, lower(replace(translate(s_name || 'Äß', 'äöüÄÖÜ', 'aouAOU'), 'ß', 'ss')) AS folded FROM supplier")
def p22_fold_names(spark: SparkSession, d: str) -> DataFrame:
    """Every second name comes in ISO 8859-1, which is no UTF-8."""
    name = F.concat("s_name", F.lit("Äß"))
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.encode(name, "iso-8859-1")).otherwise(F.encode(name, "UTF-8"))
    return _t(spark, d, "supplier").select("s_suppkey", tx.fold(tx.decode(raw)).alias("folded"))


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY 1")
def p25_week_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy(tx.week(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))


@query("SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages")
def p26_local_part(spark: SparkSession, d: str) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return _t(spark, d, "pages").select("page_id", tx.local_part(F.concat(host, F.lit("@lists"))).alias("host"))


# ---------------------------------------------------------------- filters


@query("SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
def f1_time_window(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-10' AND ts <= TIMESTAMP_NTZ '2024-01-12'").select("user_id").distinct()


@query("SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def f2_valid_ids(spark: SparkSession, d: str) -> DataFrame:
    bad = _t(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id")).distinct().join(bad, "id", "left_anti")


@query("SELECT l_orderkey, bool_and(p_type LIKE 'ECONOMY%' OR p_type LIKE 'STANDARD%' OR p_brand = 'Brand#11') AS in_project FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def f4_patches_project(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.when(F.col("p_brand") == "Brand#11", "README").otherwise(F.col("p_type")).alias("f"))
    return files.groupBy("l_orderkey").agg(F.collect_set("f").alias("affected")).select("l_orderkey", tx.in_project(F.col("affected"), ["ECONOMY", "STANDARD"], ["README"]).alias("in_project"))


@query("SELECT DISTINCT doc_id, word AS sha FROM (SELECT doc_id, regexp_extract(line, '([0-9a-f]{5,40})', 1) AS word FROM (SELECT doc_id, 'cherry picked from ' || line AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))) WHERE word IN (SELECT lower(regexp_extract(text, '([0-9a-f]{5,40})', 1)) FROM documents) AND word <> ''")
def f12_cherry_semi(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", F.concat(F.lit("cherry picked from "), "l").alias("line"))
    found = lines.filter(tx.is_cherry_pick(F.col("line"))).select("doc_id", F.regexp_extract("line", tx.SHA, 1).alias("sha")).filter("sha <> ''")
    known = docs.select(F.lower(F.regexp_extract("text", tx.SHA, 1)).alias("sha")).distinct()
    return found.join(known, "sha", "left_semi").select("doc_id", "sha").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 AND o_totalprice < (SELECT quantile_cont(o_totalprice, 0.995) FROM orders WHERE o_totalprice > 0)")
def f19_quantile_trim(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").filter("o_totalprice > 0").select("o_orderkey", "o_totalprice")
    bound = rows.agg(F.percentile("o_totalprice", 0.995).alias("bound"))
    # One row.
    return rows.crossJoin(F.broadcast(bound)).filter("o_totalprice < bound").select("o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- joins


@query("SELECT a.l_orderkey AS a, b.l_orderkey AS b, count(DISTINCT a.l_partkey) AS shared FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey GROUP BY 1, 2")
def j1_block_exact(spark: SparkSession, d: str) -> DataFrame:
    # A pair is made at the smallest part that it shares, and all that it shares is counted there; rows of a task do not grow with the table.
    tasks = _tasks(spark, d, "lineitem")
    items = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey").repartition(tasks, "id")
    files = items.groupBy("id").agg(F.collect_set("l_partkey").alias("all")).withColumn("file", F.explode("all")).repartition(tasks, "file")
    a, b = files.alias("a"), files.alias("b")
    both = F.array_intersect("a.all", "b.all")
    met = a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.id") < F.col("b.id"))).filter(F.array_min(both) == F.col("a.file"))
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.size(both).cast("long").alias("shared"))


@query("SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE abs(floor((epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) / 86400000000)) < 20")
def j3_date_band(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    a, b = o.alias("a"), o.alias("b")
    band = F.abs(tx.floor_days(F.col("a.ts"), F.col("b.ts"))) < 20
    return a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") != F.col("b.o_orderkey")) & band).select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"))


@query("WITH tags AS (SELECT 'v' || year(t) || '.' || quarter(t) AS tag, t AS ts FROM (SELECT unnest(generate_series(TIMESTAMP '1994-10-01', TIMESTAMP '2003-01-01', INTERVAL 3 MONTH)) AS t)) SELECT o_orderkey, tag AS version FROM orders ASOF JOIN tags ON o_orderdate >= ts")
def j6_version_asof(spark: SparkSession, d: str) -> DataFrame:
    t = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ '1994-10-01', TIMESTAMP_NTZ '2003-01-01', INTERVAL 3 MONTH)) AS ts")
    tags = t.select(F.concat(F.lit("v"), F.year("ts"), F.lit("."), F.quarter("ts")).alias("tag"), "ts")
    return rp.asof(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), tags, "o_orderdate", "ts", "tag").select("o_orderkey", F.col("tag").alias("version"))


@query(f"WITH {_STACKS} SELECT ord, lead(ord) OVER (ORDER BY ord) AS successor, lag(ord) OVER (ORDER BY ord) AS predecessor FROM (SELECT DISTINCT ord FROM stacks)")
def j8_successor(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy("ord")
    return _stacks(spark, d).select("ord").distinct().select("ord", F.lead("ord").over(w).alias("successor"), F.lag("ord").over(w).alias("predecessor"))


@query(f"""WITH {_STACKS}, a AS (SELECT DISTINCT grp FROM stacks WHERE ord = 7984), b AS (SELECT DISTINCT grp FROM stacks WHERE ord = 7985)
SELECT coalesce(a.grp, b.grp) AS grp, CASE WHEN b.grp IS NULL THEN 'dropped' WHEN a.grp IS NULL THEN 'new' ELSE 'invariant' END AS flow FROM a FULL JOIN b ON a.grp = b.grp""")
def j9_patch_flow(spark: SparkSession, d: str) -> DataFrame:
    s = _stacks(spark, d)
    return rp.flow(s.filter("ord = 7984").select("grp").distinct(), s.filter("ord = 7985").select("grp").distinct(), "grp")


@query("SELECT DISTINCT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_name LIKE '%7' OR n_name = 'FRANCE'")
def j11_sections_of_person(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").join(F.broadcast(_t(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    return s.filter("s_name like '%7'").unionByName(s.filter("n_name = 'FRANCE'")).select("s_suppkey", "n_name").distinct()


@query("SELECT c_custkey, coalesce(o.n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def j19_left_fill(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return _t(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["n"])


# ---------------------------------------------------------------- aggregations


@query("SELECT l_orderkey AS cluster_id, min_by(l_linenumber, (l_shipdate, l_linenumber)) AS upstream FROM lineitem GROUP BY 1")
def a2_first_upstream(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cluster_id")).agg(F.min_by("l_linenumber", F.struct("l_shipdate", "l_linenumber")).alias("upstream"))


_SIDES = "sides AS (SELECT o_orderkey AS cluster_id, o_orderdate AS down, l_linenumber AS id, l_shipdate AS up FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"WITH {_SIDES} SELECT cluster_id, CAST(min(down) AS DATE) AS first_submission, CAST(min(up) AS DATE) AS integration, count(*) AS num_up, CAST(floor((epoch_us(min(up)) - epoch_us(min(down))) / 86400000000) AS INTEGER) AS dur FROM sides GROUP BY 1")
def a3_upstream_duration(spark: SparkSession, d: str) -> DataFrame:
    return rp.durations(_both_sides(spark, d))


@query(f"WITH {_SIDES} SELECT cluster_id, CAST(floor((epoch_us(min(down)) - epoch_us(min(up))) / 86400000000) AS INTEGER) AS history FROM sides GROUP BY 1")
def a4_history(spark: SparkSession, d: str) -> DataFrame:
    """First stack by first upstream date."""
    return _both_sides(spark, d).groupBy("cluster_id").agg(tx.floor_days(F.min("down"), F.min("up")).alias("history"))


@query(f"WITH {_MEMBERS} SELECT cluster_id, max(id) AS representative FROM members WHERE NOT is_upstream GROUP BY 1")
def a5_representative(spark: SparkSession, d: str) -> DataFrame:
    return cl.representative(_members(spark, d), F.col("id"))


_STATS = "SELECT count(*) AS clusters, CAST(sum(down) AS BIGINT) AS downstream, CAST(sum(up) AS BIGINT) AS upstream, count(*) FILTER (up > 0 AND down > 0) AS integrated, " + ", ".join(f"count(*) FILTER ({s} = {n}) AS {s}_{n}" for s in ("down", "up") for n in (1, 2, 3, 4)) + ", " + ", ".join(f"count(*) FILTER ({s} >= 5) AS {s}_5_more" for s in ("down", "up")) + " FROM (SELECT cluster_id, count(*) FILTER (NOT is_upstream) AS down, count(*) FILTER (is_upstream) AS up FROM members GROUP BY 1)"


@query(f"WITH {_MEMBERS} {_STATS}")
def a6_clusterstats(spark: SparkSession, d: str) -> DataFrame:
    return cl.statistics(_members(spark, d))


@query("SELECT l_suppkey AS section, CAST(sum(p_size) AS BIGINT) AS lines, count(DISTINCT l_partkey) AS files FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1")
def a7_section_stats(spark: SparkSession, d: str) -> DataFrame:
    return rp.section_stats(_sections(spark, d))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("section"), F.col("p_size").alias("lines"))


@query("""WITH f AS (SELECT DISTINCT l_partkey AS file, l_suppkey % 20 AS section, p_size AS lines FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.section AS src, b.section AS dst, CAST(sum(a.lines) AS BIGINT) AS lines, count(*) AS files FROM f a JOIN f b ON a.file = b.file AND a.section <= b.section GROUP BY 1, 2 UNION ALL SELECT n_nationkey, n_nationkey, 0, 0 FROM nation WHERE n_nationkey NOT IN (SELECT section FROM f)""")
def a8_section_graph(spark: SparkSession, d: str) -> DataFrame:
    """Twenty sections with files, and those of the nations that have none."""
    graph = rp.section_graph(_sections(spark, d).select("file", (F.col("section") % 20).alias("section"), "lines").distinct())
    return se.with_lonely(graph, _t(spark, d, "nation").select(F.col("n_nationkey").alias("section")))


@query(f"WITH {_STACKS} SELECT grp, min(ord) AS oldest, max(ord) AS latest, min_by(ord, (day, ord)) AS first_released, max_by(ord, (day, ord)) AS last_released FROM stacks GROUP BY 1")
def a10_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return rp.occurrence(_stacks(spark, d))


@query(f"WITH {_STACKS} SELECT ord, max(day) AS release FROM stacks GROUP BY 1")
def a11_release_dates(spark: SparkSession, d: str) -> DataFrame:
    return _stacks(spark, d).groupBy("ord").agg(F.max("day").alias("release"))


@query(f"WITH {_STACKS} SELECT ord, count(*) AS commits FROM stacks GROUP BY 1")
def a13_stack_counts(spark: SparkSession, d: str) -> DataFrame:
    return _stacks(spark, d).groupBy("ord").agg(F.count("*").alias("commits"))


@query(f"WITH {_WEEKLY} SELECT week, list, type, count(*) AS n FROM weekly GROUP BY GROUPING SETS ((week, list, type), (week, list))")
def a16_grouping_sum(spark: SparkSession, d: str) -> DataFrame:
    return _weekly(spark, d).groupingSets([["week", "list", "type"], ["week", "list"]], "week", "list", "type").agg(F.count("*").alias("n"))


@query(f"WITH {_WEEKLY} SELECT list, type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY list), 6) AS share FROM weekly GROUP BY 1, 2")
def a17_proportion(spark: SparkSession, d: str) -> DataFrame:
    n = _weekly(spark, d).groupBy("list", "type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("list")), 6))


@query(f"WITH {_WEEKLY}, y AS (SELECT unnest(range(1994, 2004)) AS year) SELECT CAST(y.year AS INTEGER) AS year, round(avg(CAST(ignored AS INTEGER)), 6) AS rate FROM y LEFT JOIN weekly w ON w.year = y.year GROUP BY 1 UNION ALL SELECT NULL, round(avg(CAST(ignored AS INTEGER)), 6) FROM weekly")
def a18_ignore_rate(spark: SparkSession, d: str) -> DataFrame:
    years = spark.range(1994, 2004).select(F.col("id").cast("int").alias("year"))
    rate, w = F.round(F.avg(F.col("ignored").cast("int")), 6).alias("rate"), _weekly(spark, d)
    return years.join(w, "year", "left").groupBy("year").agg(rate).unionByName(w.agg(rate).withColumn("year", F.lit(None).cast("int")))


@query(f"""WITH {_WEEKLY}, lim AS (SELECT min(week) AS lo, max(week) AS hi FROM weekly), w AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week FROM lim), l AS (SELECT DISTINCT list FROM weekly)
SELECT w.week, l.list, coalesce(n, 0) AS n FROM w CROSS JOIN l LEFT JOIN (SELECT week, list, count(*) AS n FROM weekly WHERE type = 'P' GROUP BY 1, 2) c ON c.week = w.week AND c.list = l.list""")
def a19_week_gapfill(spark: SparkSession, d: str) -> DataFrame:
    w = _weekly(spark, d)
    return rp.fill_weeks(w, w.filter("type = 'P'").groupBy("week", "list").agg(F.count("*").alias("n")))


@query("SELECT source, n FROM (SELECT source, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM documents GROUP BY 1) WHERE r <= 4")
def a20_top_n_ties(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.rank().over(Window.orderBy(F.desc("n")))).filter("r <= 4").drop("r")


@query("SELECT days, round(max(c), 6) AS ecdf FROM (SELECT days, cume_dist() OVER (ORDER BY days) AS c FROM (SELECT CAST(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000) AS INTEGER) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey)) GROUP BY 1")
def a22_ecdf(spark: SparkSession, d: str) -> DataFrame:
    return rp.ecdf(_both_sides(spark, d).select(tx.floor_days(F.col("up"), F.col("down")).alias("days")), "days")


@query("SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def a23_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 50000).alias("bucket")).agg(F.count("*").alias("n"))


_RATED = "(SELECT doc_id, (doc_id * 7 % 101) / 100.0::DOUBLE AS msg, (doc_id * 13 % 101) / 100.0::DOUBLE AS diff, (doc_id * 3 % 11) / 10.0::DOUBLE AS dlr FROM documents)"
_DECIDE = "CASE WHEN dlr < 0.3 THEN 'skipped' WHEN 0.4::DOUBLE * msg + 0.6::DOUBLE * diff >= 0.8 THEN 'accepted' WHEN 0.4::DOUBLE * msg + 0.6::DOUBLE * diff < 0.5 THEN 'declined' ELSE 'manual' END"


def _decided(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rated = _t(spark, d, "documents").select("doc_id", (i * 7 % 101 / 100.0).alias("msg"), (i * 13 % 101 / 100.0).alias("diff"), (i * 3 % 11 / 10.0).alias("dlr"))
    return rated.select("doc_id", sim.decision(F.col("msg"), F.col("diff"), F.col("dlr"), 0.4, 0.8, 0.5, 0.3).alias("decision"))


@query(f"SELECT doc_id, {_DECIDE} AS decision FROM {_RATED}")
def m6_decide(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)


@query(f"SELECT {_DECIDE} AS decision, count(*) AS n FROM {_RATED} GROUP BY 1")
def a24_decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- set operations


@query(f"WITH {_MEMBERS} SELECT cluster_id, count(*) FILTER (NOT is_upstream) AS down, count(*) FILTER (is_upstream) AS up, min(id) FILTER (NOT is_upstream) AS first_down, min(id) FILTER (is_upstream) AS first_up FROM members GROUP BY 1")
def o5_split(spark: SparkSession, d: str) -> DataFrame:
    down, up = ~F.col("is_upstream"), F.col("is_upstream")
    return _members(spark, d).groupBy("cluster_id").agg(F.count_if(down).alias("down"), F.count_if(up).alias("up"), F.min(F.when(down, F.col("id"))).alias("first_down"), F.min(F.when(up, F.col("id"))).alias("first_up"))


@query("UNPIVOT (SELECT o_orderpriority AS list, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1) ON done, open INTO NAME what VALUE n")
def o7_unpivot(spark: SparkSession, d: str) -> DataFrame:
    wide = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("list")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return wide.unpivot("list", ["done", "open"], "what", "n")


# ---------------------------------------------------------------- metrics


def _table(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return cl.contingency(e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id")), e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7).alias("cluster_id")))


_TABLE = "tab AS (SELECT label AS t, vec_id % 7 AS p, count(*) AS n FROM embeddings GROUP BY 1, 2), t AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS total, sum(n * ln(n)) AS x FROM (SELECT t, sum(n)::DOUBLE AS n FROM tab GROUP BY 1)), p AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS x FROM (SELECT p, sum(n)::DOUBLE AS n FROM tab GROUP BY 1)), b AS (SELECT sum(n::DOUBLE * (n - 1) / 2) AS s, sum(n * ln(n)) AS x FROM tab)"


@query(f"WITH {_TABLE} SELECT b.s::BIGINT AS tp, (p.s - b.s)::BIGINT AS fp, (t.s - b.s)::BIGINT AS fn, (t.total * (t.total - 1) / 2 - p.s - t.s + b.s)::BIGINT AS tn, b.s / p.s AS precision, b.s / t.s AS recall, 2 * b.s / (p.s + t.s) AS f FROM b, p, t")
def m1_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return cl.pair_counts(_table(spark, d))


@query(f"WITH {_TABLE}, m AS (SELECT ln(total) AS l, total, ln(total) + (b.x - t.x - p.x) / total AS mi, ln(total) - t.x / total AS ht, ln(total) - p.x / total AS hp, b.s AS bs, t.s AS ts, p.s AS ps, t.s * p.s / (total * (total - 1) / 2) AS e FROM b, p, t) SELECT round(mi / ht, 6) AS homogeneity, round(mi / hp, 6) AS completeness, round(2 * mi / (ht + hp), 6) AS v_measure, round(mi, 6) AS mutual_information, round(2 * mi / (ht + hp), 6) AS nmi, round((bs - e) / ((ts + ps) / 2 - e), 6) AS adjusted_rand, round(bs / sqrt(ts * ps), 6) AS fowlkes_mallows, round((SELECT sum(m) FROM (SELECT max(n) AS m FROM tab GROUP BY t)) / total, 6) AS purity FROM m")
def m2_m3_m4_scores(spark: SparkSession, d: str) -> DataFrame:
    s = cl.entropy_scores(_table(spark, d))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


# ---------------------------------------------------------------- graphs and threads


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_suppkey // 7 * 7 AS b FROM lineitem), r AS (SELECT a AS id, a AS n FROM e UNION SELECT b, b FROM e UNION SELECT r.id, CASE WHEN e.a = r.n THEN e.b ELSE e.a END FROM r JOIN e ON e.a = r.n OR e.b = r.n) SELECT id, min(n) AS cluster_id FROM r GROUP BY 1""")
def g1_components(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.expr("cast(l_suppkey div 7 * 7 as bigint)").alias("b")).distinct()
    return cl.components(e, e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))))


@query(f"WITH {_MAILS} SELECT id, '<' || conv_id || '.0@x>' AS root, CAST(turn AS INTEGER) AS depth FROM mails")
def g4_thread_root(spark: SparkSession, d: str) -> DataFrame:
    return th.roots(_mails(spark, d).select("id", "parent"))


@query(f"WITH {_MAILS} SELECT m.id, count(DISTINCT o.author) > 0 AS foreign_response FROM mails m LEFT JOIN mails o ON o.conv_id = m.conv_id AND o.turn > m.turn AND o.author <> m.author GROUP BY 1")
def g7_foreign_response(spark: SparkSession, d: str) -> DataFrame:
    return th.foreign_response(_mails(spark, d).select("id", "parent", "author"))


@query(f"WITH {_MAILS} SELECT id, parent, '<' || conv_id || '.0@x>' AS root, CAST(turn + 1 AS INTEGER) AS position FROM mails")
def g8_preorder(spark: SparkSession, d: str) -> DataFrame:
    return th.preorder(_mails(spark, d).select("id", "parent"))


@query(f"WITH {_SIDES} SELECT cluster_id, CASE WHEN min(up) IS NULL THEN 'none' WHEN floor((epoch_us(min(up)) - epoch_us(min(down))) / 86400000000) < -1 THEN 'backport' ELSE 'forwardport' END AS class FROM (SELECT cluster_id, down + INTERVAL 30 DAY AS down, up FROM sides) GROUP BY 1")
def c1_composition(spark: SparkSession, d: str) -> DataFrame:
    return rp.composition(_both_sides(spark, d).select("cluster_id", (F.col("down") + F.expr("INTERVAL 30 DAY")).alias("down"), "up"))


# ---------------------------------------------------------------- whole analyses


@query(f"WITH {_WEEKLY} SELECT list, week, count(*) AS mails, round(avg(CAST(ignored AS INTEGER)), 6) AS rate FROM weekly WHERE ignored IS NOT NULL GROUP BY 1, 2")
def q22_weekly_ignored(spark: SparkSession, d: str) -> DataFrame:
    return _weekly(spark, d).filter("ignored is not null").groupBy("list", "week").agg(F.count("*").alias("mails"), F.round(F.avg(F.col("ignored").cast("int")), 6).alias("rate"))


@query("SELECT * FROM events WHERE event_id % 2 = 0 UNION ALL SELECT * FROM events WHERE event_id % 2 = 1 AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 2 = 0)")
def r3_incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return rp.refresh(e.filter("event_id % 2 = 0"), e, "event_id")
