"""Git repositories as a data source: commits, cherries, tags, trees, blobs and public inboxes.

    spark.dataSource.register(GitSource)
    spark.read.format("git").option("repo", path).option("mode", "commits").option("range", "v1..v2").load()

The driver lists ids only; contents are read by tasks, CHUNK ids each. The
repository must be at the same path for all executors.
"""

from __future__ import annotations

import os
import subprocess
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1000
_WHO = "author_name string, author_email string, author_date timestamp, committer_name string, committer_email string, commit_date timestamp"
SCHEMAS = {
    "log": "pos long, commit string",
    "cherry": "pos long, commit string, removed boolean",
    "commits": f"commit string, parents array<string>, {_WHO}, message array<string>, diff array<string>",
    "tags": "tag string, date timestamp",
    "tree": "path string, kind string, oid string, size long",
    "blobs": "path string, content binary, lines long, size long",
    "pubin": "list string, shard int, commit string, raw binary",
}


def git(repo: str, *args: str, stdin: str | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=None if stdin is None else stdin.encode(), capture_output=True, check=True).stdout


@dataclass
class Chunk(InputPartition):
    repo: str
    ids: list = field(default_factory=list)
    tag: tuple = ()


def _chunks(repo: str, ids: list, tag: tuple = ()) -> list[Chunk]:
    return [Chunk(repo, ids[i : i + CHUNK], tag) for i in range(0, len(ids), CHUNK)] or [Chunk(repo)]


def _when(seconds: str) -> datetime:
    return datetime.fromtimestamp(int(seconds), UTC)


def _batch(repo: str, names: list[str]) -> Iterator[bytes | None]:
    """The contents of the objects with these names, None for those that are missing."""
    data, at = git(repo, "cat-file", "--batch", stdin="".join(f"{n}\n" for n in names)), 0
    for _ in names:
        end = data.index(b"\n", at)
        head = data[at:end].rsplit(b" ", 2)
        at = end + 1
        if data[:end].endswith(b" missing"):
            yield None
            continue
        yield data[at : at + int(head[2])]
        at += int(head[2]) + 1


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.mode, self.repo = options.get("mode", "log"), options["repo"]
        self.range, self.base = options.get("range", "HEAD"), options.get("base")

    def _listed(self) -> list[str]:
        return git(self.repo, "rev-list", "--no-merges", self.range).decode().split()

    def partitions(self) -> list[Chunk]:
        if self.mode == "commits":
            return _chunks(self.repo, self._listed())
        if self.mode == "log":
            return _chunks(self.repo, list(enumerate(self._listed())))
        if self.mode == "blobs":
            names = git(self.repo, "ls-tree", "-r", "-z", "--name-only", self.range).decode("utf-8", "surrogateescape").split("\0")
            return _chunks(self.repo, [n for n in names if n and "\n" not in n])
        if self.mode == "pubin":
            return self._shards()
        return [Chunk(self.repo)]

    def _shards(self) -> list[Chunk]:
        """0.git, 1.git and so on up to the first that is missing; the first must be there."""
        out, n, name = [], 0, os.path.basename(os.path.normpath(self.repo))
        while os.path.isdir(shard := os.path.join(self.repo, f"{n}.git")):
            out += _chunks(shard, git(shard, "rev-list", "HEAD").decode().split(), (name, n))
            n += 1
        if not n:
            raise FileNotFoundError(f"{self.repo} has no 0.git")
        return out

    def read(self, partition: Chunk) -> Iterator[tuple]:
        return getattr(self, f"_{self.mode}")(partition)

    def _log(self, p: Chunk) -> Iterator[tuple]:
        yield from p.ids

    def _cherry(self, p: Chunk) -> Iterator[tuple]:
        """The commits of a stack that its base lacks, newest first; those that the base has in another form are marked."""
        lines = git(p.repo, "cherry", self.base, self.range).decode().splitlines()
        for pos, line in enumerate(reversed(lines)):
            yield pos, line[2:], line[0] == "-"

    def _tags(self, p: Chunk) -> Iterator[tuple]:
        """Tags of commits by the committer's date; tags of anything else are left out."""
        form = "%(refname:strip=2)%00%(committerdate:unix)%00%(*committerdate:unix)"
        for line in git(p.repo, "for-each-ref", "refs/tags", f"--format={form}").decode().splitlines():
            tag, light, annotated = line.split("\0")
            if light or annotated:
                yield tag, _when(light or annotated)

    def _tree(self, p: Chunk) -> Iterator[tuple]:
        for line in git(p.repo, "ls-tree", "-r", "-t", "-l", "-z", self.range).decode("utf-8", "replace").split("\0"):
            if line:
                head, path = line.split("\t", 1)
                _, kind, oid, size = head.split()
                if kind != "commit":
                    yield path, kind, oid, None if size == "-" else int(size)

    def _blobs(self, p: Chunk) -> Iterator[tuple]:
        for name, data in zip(p.ids, _batch(p.repo, [f"{self.range}:{n}" for n in p.ids]), strict=True):
            if data is not None:
                yield name, data, data.count(b"\n"), len(data)

    def _pubin(self, p: Chunk) -> Iterator[tuple]:
        """The mail of each commit, which is m, or d in some spam; commits with neither have none."""
        if not p.ids:
            return
        mails, spam = _batch(p.repo, [f"{c}:m" for c in p.ids]), _batch(p.repo, [f"{c}:d" for c in p.ids])
        for commit, m, d in zip(p.ids, mails, spam, strict=True):
            if m is not None or d is not None:
                yield *p.tag, commit, m if m is not None else d

    def _commits(self, p: Chunk) -> Iterator[tuple]:
        """Root commits and merges have no diff."""
        if not p.ids:
            return
        mark = uuid.uuid4().hex
        form = f"{mark}%H%x00%P%x00%an%x00%ae%x00%at%x00%cn%x00%ce%x00%ct%x00%B%x00"
        out = git(p.repo, "-c", "log.showroot=false", "log", "--no-walk=unsorted", "--stdin", "-p", "-M", f"--format={form}", stdin="\n".join(p.ids) + "\n")
        for each in out.decode("utf-8", "replace").split(mark)[1:]:
            sha, parents, an, ae, at, cn, ce, ct, message, diff = each.split("\0", 9)
            diff = diff.strip("\n")
            yield sha, parents.split(), an, ae, _when(at), cn, ce, _when(ct), message.rstrip("\n").split("\n"), diff.split("\n") if diff else []


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("mode", "log")]

    def reader(self, schema: object) -> GitReader:
        return GitReader(dict(self.options))
