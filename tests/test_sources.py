"""Mails, diffs, section files and git repositories, read and parsed."""

import subprocess

import pytest

from patchloom.functions import diff as df
from patchloom.functions import mail as ml
from patchloom.functions import sections as sc
from patchloom.sources import mbox
from patchloom.sources.git import GitSource

DIFF = """diff --git a/x.c b/x.c
--- a/x.c
+++ b/x.c
@@ -1,2 +1,2 @@ main
-old
\\ No newline at end of file

+new
@@ -9 +9,2 @@ main
\tcontext
+more
diff --git a/p b/q
similarity index 100%
rename from p
rename to q
--
2.0
"""
MAIL = f"""From: A Person <a@b.org>
To: List <L@b.org>, nobody
Cc: c@d.org
Subject: [PATCH v2 1/3] foo: bar
Date: Mon, 1 Jan 2024 02:00:00 +0200
Message-ID: <1@b.org>

why

Signed-off-by: A
---
notes
{DIFF}"""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None), ("", None), ("only words", None),
        ("m\n---\nnote\n---\ndiff --git", (["m"], ["note", "---"], ["diff --git"])),
        ("--\nm\nINDEX: f\n---", (["m"], None, ["INDEX: f", "---"])),
        ("--- a/x\n", None), ("a\f--- b\n--- a/x.c\n", (["a --- b"], None, ["--- a/x.c"])),
    ],
)
def test_split_message(text, want):
    assert ml.split_message(text) == want


def test_parse_mail(spark):
    nested = 'From: x@y.z\nSubject: s\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain\n\nwords\n--b\nContent-Type: text/x-patch\n\n' + DIFF + "\n--b--\n"
    rows = spark.createDataFrame([(1, MAIL.encode()), (2, None), (3, nested.encode()), (4, b"From: a@b.c\n\nno patch")], "id long, raw binary")
    got = {r.id: r for r in ml.parse_mails(rows).collect()}
    one = got[1]
    assert (one.message_id, one.author_name, one.author_email, one.recipients) == ("<1@b.org>", "A Person", "a@b.org", ["c@d.org", "l@b.org"])
    assert one.message == ["foo: bar", "", "why", "", "Signed-off-by: A"] and one.annotation == ["notes"] and one.date.isoformat().startswith("2024-01-01T00:00")
    assert not got[2].valid and not got[4].valid and got[4].diff is None
    assert got[3].message[:3] == ["s", "", "words"] and got[3].diff[0] == "diff --git a/x.c b/x.c"


def test_parse_diff(spark):
    rows = spark.createDataFrame([(1, DIFF.split("\n")), (2, None), (3, ["--- a/x", "+++ b/x", "@@ -1,3 +1 @@", "-a"]), (4, ["diff --cc x"]), (5, [])], "id long, diff array<string>")
    got = {r.id: r for r in df.parse_diffs(rows).collect()}
    x, moved = got[1].files
    assert (x.names, x.similarity, [h.heading for h in x.hunks]) == (["x.c"], 0, ["main"])
    assert (x.hunks[0].insertions, x.hunks[0].deletions, x.hunks[0].context) == (["new", "more"], ["old"], ["\tcontext"])
    assert (moved.names, moved.similarity, moved.hunks) == (["p", "q"], 100, [])
    assert (got[1].affected, got[1].lines, got[1].footer, got[1].valid) == (["p", "q", "x.c"], 3, 3, True)
    assert [got[i].valid for i in (2, 3, 4, 5)] == [True, False, False, True] and got[5].files == []


def test_path_names():
    assert df.path_names("a/x/y.c.orig", "b/x/y.c") == ("x/y.c",)
    assert df.path_names("/dev/null", "b/new") == ("/dev/null", "new")


def test_sections(spark):
    text = 'words\nonly\n\nONE "A"\nTWO\nM:\tJane Doe <Jane@X.org>\nL:\tlist@x.org (moderated)\nL:\thttp://x.org\nS:\tOdd Fixes / Orphaned\nF\tdrivers/\n\tmore\n\nTHREE\nS:\tMaintained:\nP:\tSomebody\n\nTHREE\nR:\t"J. Q." <j@q.org>\n'
    rows = spark.createDataFrame([("v1", text), ("v2", None), ("v3", "")], "version string, text string")
    got = sorted((r.section, r.kind, r.value, r.name, r.mail) for r in sc.parse_sections(rows).collect())
    assert [x for x in got if x[0] == "THREE"] == [("THREE", "R", '"j. q." <j@q.org>', "j. q.", "j@q.org")]
    one = [x[1:] for x in got if x[0] == "ONE A / TWO"]
    assert one == [("F", "drivers/", None, None), ("L", "list@x.org (moderated)", None, "list@x.org"), ("M", "jane doe <jane@x.org>", "jane doe", "jane@x.org"), ("S", "odd fixes", None, None), ("S", "orphaned", None, None)]


def test_mbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "box").write_bytes(b"From a Mon\nSubject: 1\n\n\xe4 body\n\nFrom b Tue\nSubject: 2\n\nFrom here on\n\nFrom c\nSubject: 1\n\n\xe4 body\n")
    got = sorted(bytes(r.raw) for r in mbox.read_mbox(spark, str(tmp_path / "in")).collect())
    assert got[0] == b"Subject: 1\n\n\xe4 body\n" and len(set(got)) == len(got)
    q = mbox.stream_mbox(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("mails").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("mails").count() == len(got)


def test_git(spark, tmp_path):
    repo = tmp_path / "list" / "0.git"
    repo.mkdir(parents=True)

    def git(*args):
        return subprocess.run(["git", "-c", "user.name=N", "-c", "user.email=n@x.org", *args], cwd=repo, check=True, capture_output=True, text=True).stdout.strip()

    git("init", "-q", "-b", "main")
    for n in range(3):
        (repo / "m").write_text(f"From: a@b.c\n\nmail {n}\n")
        git("add", "m")
        git("commit", "-q", "-m", f"mail {n}\n\nbody")
        if n == 0:
            git("tag", "v0")
            git("branch", "base")
    git("tag", "-a", "v1", "-m", "one")
    spark.dataSource.register(GitSource)

    def read(mode, path=repo, **options):
        return spark.read.format("git").option("repo", str(path)).option("mode", mode).options(**options).load().collect()

    assert [r.commit for r in sorted(read("log", range="v0..v1"))] == git("rev-list", "v0..v1").split()
    commits = {r.message[0]: r for r in read("commits")}
    assert commits["mail 0"].diff == [] and "+mail 2" in commits["mail 2"].diff and commits["mail 1"].message == ["mail 1", "", "body"] and commits["mail 1"].author_name == "N"
    assert [r.commit for r in sorted(read("cherry", base="base", range="main"))] == git("rev-list", "base..main").split()
    assert {r.tag for r in read("tags")} == {"v0", "v1"}
    assert [(r.path, r.kind) for r in read("tree")] == [("m", "blob")]
    assert [(r.path, r.lines, bytes(r.content)[-7:]) for r in read("blobs")] == [("m", 3, b"mail 2\n")]


def test_empty_tables(spark):
    assert ml.parse_mails(spark.createDataFrame([], "id long, raw binary, subject string")).count() == 0
    assert df.parse_diffs(spark.createDataFrame([], "id long, diff array<string>, files int")).count() == 0
    assert sc.parse_sections(spark.createDataFrame([], "version string, text string, section int")).count() == 0


def test_context_diff_is_read_as_a_unified_one():
    from patchloom.functions import diff

    text = """*** a/x.c\t2001-01-01
--- b/x.c\t2001-01-02
***************
*** 1,4 ****
  one
! two
  three
- four
--- 1,4 ----
  one
! TWO
! more
  three
***************
*** 9 ****
--- 10,11 ----
  nine
+ ten"""
    got = diff.parse(text.split("\n"))
    hunk = got["files"][0]["hunks"][0]
    assert got["valid"] and got["affected"] == ["x.c"] and got["lines"] == 5
    assert (hunk["deletions"], hunk["insertions"], hunk["context"]) == (["two", "four"], ["TWO", "more", "ten"], ["one", "three", "nine"])
    assert not diff.parse(["*** 1,2 ****", "***************"])["valid"]


def test_mails_are_filed_by_their_dates(spark):
    from patchloom.functions import mail

    mails = [
        b"Date: Tue, 3 Mar 2020 23:30:00 -0500\n\nx", b"Date: Tue, 3 Mar 2020 10.20.30 +0000\n\nx", b"Date: nonsense\nNNTP-Posting-Date: Wed, 4 Mar 2020 10:00:00 GMT\n\nx",
        b"Received: from a by b; Thu, 5 Mar 2020 10:00:00 +0000\n\nx", b"Date: Tue, 3 Mar 1959 10:00:00 +0000\n\nx", b"\n", b"Received: from a by b; Thu, 5 Mar 2020 10:00:00 +0000\n\nx",
    ]
    got = sorted(r.location[:10] for r in mail.file_mails(spark.createDataFrame([(m,) for m in mails] + [(None,)], "raw binary")).collect())
    assert got == ["2020/03/03", "2020/03/04", "2020/03/04", "2020/03/05"]


def test_a_store_is_brought_up_to_date(spark, tmp_path):
    box, store, cp = (str(tmp_path / x) for x in ("in", "store", "cp"))
    mail = lambda i: f"From x Mon\nSubject: {i}\n\nbody {i}\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("\n".join(map(mail, [1, 2, 2, 3])))
    mbox.sync_mbox(spark, box, store, cp).awaitTermination()
    assert mbox.stored(spark, store).count() == 3
    (tmp_path / "in/b").write_text("\n".join(map(mail, [3, 4])))
    mbox.sync_mbox(spark, box, store, cp).awaitTermination()
    mbox.sync_mbox(spark, box, store, cp).awaitTermination()
    rows = mbox.stored(spark, store).collect()
    assert len(rows) == 4 and sorted({r.batch for r in rows}) == [0, 1]
    # The last batch is taken back, as after a failure before it was noted: it is run again and gives the same.
    (tmp_path / "cp/commits/1").unlink()
    for crc in (tmp_path / "cp/commits").glob(".1.*"):
        crc.unlink()
    mbox.sync_mbox(spark, box, store, cp).awaitTermination()
    again = mbox.stored(spark, store).collect()
    assert sorted((r.md5, r.batch) for r in again) == sorted((r.md5, r.batch) for r in rows)
