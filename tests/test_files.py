"""What the sinks write, the file sources read back."""

import pytest
from pyspark.sql import functions as F

from patchloom.sinks import exports as ex
from patchloom.sinks import files as out
from patchloom.sources import files as src


def text(path):
    parts = sorted(p for p in path.iterdir() if p.name.startswith("part"))
    return "".join(p.read_text() for p in parts)


def test_clusters_round_trip(spark, tmp_path):
    rows = [("d2", 1, False), ("d1", 1, False), ("u1", 1, True), ("d3", 2, False), ("u9", 3, True), ("u8", 3, True)]
    members = spark.createDataFrame(rows, "id string, cluster_id long, is_upstream boolean")
    out.write_clusters(members, str(tmp_path / "c"))
    assert text(tmp_path / "c") == "d1 d2 => u1\nd3\n=> u8 u9\n"
    back = {(r.id, r.cluster_id, r.is_upstream) for r in src.read_clusters(spark, str(tmp_path / "c")).collect()}
    assert back == {("d1", "d1", False), ("d2", "d1", False), ("u1", "d1", True), ("d3", "d3", False), ("u8", "u8", True), ("u9", "u8", True)}


def test_lines_that_share_an_id_are_one_cluster(spark, tmp_path):
    (tmp_path / "c").write_text("a b\nb c => u\n\nx\n")
    assert {r.id: r.cluster_id for r in src.read_clusters(spark, str(tmp_path / "c")).collect()} == {"a": "a", "b": "a", "c": "a", "u": "a", "x": "x"}


def test_index_round_trip(spark, tmp_path):
    mails = spark.sql("SELECT * FROM VALUES (DATE'2020-03-01', '<b@x>', 'l2'), (DATE'2019-12-31', '<a@x>', 'l1') AS t(day, id, location)")
    out.write_index(mails, str(tmp_path / "i"))
    assert text(tmp_path / "i") == "2019/12/31 <a@x> l1\n2020/03/01 <b@x> l2\n"
    assert {tuple(r) for r in src.read_index(spark, str(tmp_path / "i")).collect()} == {tuple(r) for r in mails.collect()}


def test_hashes_and_comments(spark, tmp_path):
    (tmp_path / "h.000").write_bytes(b"# caf\xe9\nabc\n\n")
    (tmp_path / "h.001").write_bytes(b"  def \n")
    got = src.read_hashes(spark, f"{tmp_path}/h.*").orderBy("pos").collect()
    assert [r.hash for r in got] == ["abc", "def"]
    out.write_hashes(src.read_hashes(spark, f"{tmp_path}/h.*"), str(tmp_path / "o"), "pos")
    assert text(tmp_path / "o") == "abc\ndef\n"


def test_split_csv(spark, tmp_path):
    (tmp_path / "t.000").write_text("a,b\n1,2\n")
    (tmp_path / "t.001").write_text("3,4\n")
    assert sorted(tuple(r) for r in src.read_split_csv(spark, f"{tmp_path}/t.*").select("a", "b").collect()) == [("1", "2"), ("3", "4")]


def test_false_positives(spark, tmp_path):
    pairs = spark.createDataFrame([("o", "b"), ("o", "a"), ("p", "c"), ("o", "a")], "origin string, dest string")
    out.write_false_positives(pairs, str(tmp_path / "f"))
    assert text(tmp_path / "f") == "o a b\np c\n"
    assert {tuple(r) for r in src.read_false_positives(spark, str(tmp_path / "f")).collect()} == {("o", "a"), ("o", "b"), ("p", "c")}
    assert src.read_false_positives(spark, str(tmp_path / "none")).count() == 0 and src.false_positive_file("mbox", True) == "mbox-upstream"


def test_stacks(spark, tmp_path):
    (tmp_path / "s").write_text("# stacks\nBaseCommit BaseVersion BaseReleaseDate Branch StackVersion StackReleaseDate\n## 3.0\nv3.0 3.0 2011-07-22 b1 3.0-rt1 2011-07-23\n\n## 4.0\nv4.0 4.0 2015-04-12 b2 4.0-rt1 2015-05-01\n")
    got = src.read_stacks(spark, str(tmp_path / "s")).orderBy("ord").collect()
    assert [(r.ord, r.grp, r.stack_version, str(r.stack_date)) for r in got] == [(0, "3.0", "3.0-rt1", "2011-07-23"), (1, "4.0", "4.0-rt1", "2015-05-01")]
    (tmp_path / "bad").write_text("BaseCommit\n")
    with pytest.raises(ValueError):
        src.read_stacks(spark, str(tmp_path / "bad"))


def test_section_tables(spark, tmp_path):
    graph = spark.createDataFrame([("A", "A", 5, 1), ("A", "B", 3, 1), ("A", "THE REST", 9, 2)], "`from` string, to string, lines long, size long")
    out.write_csv(graph, str(tmp_path / "g"), ["from", "to"])
    assert [tuple(r) for r in src.read_section_graph(spark, str(tmp_path / "g")).collect()] == [("A", "B", 3, 1)]
    clusters = spark.createDataFrame([("A", "B", 2)], "c_representative string, c_section string, c_size long")
    out.write_csv(clusters, str(tmp_path / "k"))
    assert [tuple(r) for r in src.read_section_clusters(spark, str(tmp_path / "k")).collect()] == [("A", "B", 2)]


def test_upstream_cache(spark, tmp_path):
    (tmp_path / "u").write_text("v1..v2\nabc\ndef\n")
    fresh = spark.createDataFrame([(1, "new")], "pos long, hash string")
    black = spark.createDataFrame([("def",)], "hash string")
    assert [r.hash for r in src.refresh_upstream(spark, str(tmp_path / "u"), "v1..v2", fresh, black).collect()] == ["abc"]
    assert [r.hash for r in src.refresh_upstream(spark, str(tmp_path / "u"), "v1..v3", fresh, black).collect()] == ["new"]


def test_config(spark, tmp_path):
    (tmp_path / "d.toml").write_text('MODE = "mbox"\nREPO = "repo"\n[thresholds]\naccept = 0.9\nweight = 0.4\n')
    (tmp_path / "p.toml").write_text('PROJECT = "p"\n[thresholds]\nweight = 0.2\n')
    c = src.read_config(spark, f"{tmp_path}/p.toml", f"{tmp_path}/d.toml")
    assert (c.mode, c.project, c.thresholds.accept, c.thresholds.weight, c.path("REPO")) == ("mbox", "p", 0.9, 0.2, f"{tmp_path}/repo")
    (tmp_path / "x.toml").write_text('MODE = "other"\n')
    with pytest.raises(ValueError):
        src.read_config(spark, f"{tmp_path}/x.toml")
    with pytest.raises(ValueError):
        src.Thresholds(accept=1.5)


def test_csv_and_metrics(spark, tmp_path):
    mails = spark.createDataFrame([("<a>", "x@y", None, "patch", "v1", ["l1", "l2"], ["l1"], True, "abc", "who", None, False, 3)], "id string, `from` string, time timestamp, type string, version string, lists array<string>, matches array<string>, ignored boolean, commithash string, committer string, correct boolean, xcorrect boolean, distance int")
    out.write_csv(out.characteristics_table(mails), str(tmp_path / "m"), ["list"])
    assert text(tmp_path / "m").splitlines() == ["id,from,time,type,version,list,list.matches_patch,ignored,commithash,committer,committer.correct,committer.xcorrect,committer.distance", "<a>,x@y,,patch,v1,l1,True,True,abc,who,,False,3", "<a>,x@y,,patch,v1,l2,False,True,abc,who,,False,3"]
    out.write_metrics(spark.createDataFrame([(0.12345, 1.0)], "homo double, comp double"), str(tmp_path / "t"))
    assert text(tmp_path / "t") == "homo: 0.123\ncomp: 1.000\n"
    r = spark.createDataFrame([("o", "a", 0.1, 0.2), ("o", "b", 0.9, 0.9)], "orig string, cand string, msg double, diff double")
    out.write_ratings(r, str(tmp_path / "r"))
    assert [x.cand for x in spark.read.parquet(str(tmp_path / "r")).collect()] == ["b", "a"]
    assert {x.id for x in out.invalidate(r.select(F.col("cand").alias("id")), r.select(F.col("orig").alias("id"))).collect()} == {"a", "b", "o"}


def test_a_whole_file_goes_before_its_parts(spark, tmp_path):
    for name, body in (("h.000", "a\n"), ("h.001", "b\n")):
        (tmp_path / name).write_text(body)
    read = lambda: [r.hash for r in src.read_hashes(spark, f"{tmp_path}/h").orderBy("pos").collect()]
    assert read() == ["a", "b"]
    (tmp_path / "h").write_text("c\n")
    assert read() == ["c"]


def test_files_are_cut_by_bytes(spark, tmp_path):
    rows = spark.range(400).selectExpr("repeat('x', cast(id % 90 AS int)) || id AS hash")
    out._lines(rows, F.col("hash"), ["hash"], f"{tmp_path}/out", limit=1000)
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert len(parts) > 20 and max(p.stat().st_size for p in parts) <= 1000
    assert [x for p in parts for x in p.read_text().split("\n") if x] == sorted(r.hash for r in rows.collect())


def test_tables_of_a_set(spark, tmp_path):
    members = spark.createDataFrame([("a", 1, False), ("b", 1, False), ("u", 1, True), ("c", 2, False), ("x", 3, True)], "id string, cluster_id int, is_upstream boolean")
    stacks = spark.sql("SELECT * FROM VALUES ('a', 'v1', 'b1', 1, DATE '2020-01-05'), ('b', 'v2', 'b1', 2, DATE '2020-01-02'), ('c', 'v2', 'b1', 2, DATE '2020-02-01'), ('c', 'v3', 'b2', 3, DATE '2020-03-01') AS t(commit, version, base, ord, day)")
    commits = spark.sql("SELECT * FROM VALUES ('u', TIMESTAMP '2020-04-01 10:00:00'), ('x', TIMESTAMP '2020-04-01 10:00:00') AS t(id, ts)")
    ex.write_tables(ex.patch_group_tables(members, stacks, commits), f"{tmp_path}/set", sep=" ")
    read = lambda name: sorted(x for p in (tmp_path / "set" / name).glob("part-*") for x in p.read_text().split("\n")[1:] if x)
    assert read("patches") == ["1 a v1 b1", "1 b v2 b1", "2 c v3 b2"]
    assert read("occurrence") == ["1 v1 v2 v2 v1", "2 v3 v3 v3 v3"]
    assert read("upstream") == ["1 u 2020-04-01 2020-01-02"]
    releases = ex.release_tables(spark.sql("SELECT * FROM VALUES ('g', 'v1', 'b1', 1, DATE '2020-01-05', DATE '2020-01-01'), ('g', 'v2', 'b1', 2, DATE '2020-02-05', DATE '2020-01-01') AS t(grp, version, base, ord, date, base_date)"))
    assert {k: v.count() for k, v in releases.items()} == {"mainline_releases": 1, "stack_releases": 2, "release_order": 2}
