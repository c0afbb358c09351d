"""Unified diffs to files and hunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The lines that a diff is made of.
OLD = re.compile(r"--- (\S+)")
NEW = re.compile(r"\+\+\+ (\S+)")
HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@ ?(.*)")
SIMILARITY = re.compile(r"similarity index (\d+)%$")
RENAME = re.compile(r"(?:rename|copy) (?:from|to) (.*)$")
MERGE = re.compile(r"diff --cc .")
CONTEXT_FORM = re.compile(r"\*\*\*\s*(\d+)(?:,\s*\d+)?\s*\*\*\*")
CONTEXT_SIDE = re.compile(r"---\s*(\d+)(?:,\s*\d+)?\s*---")
CONTEXT_HEAD, CONTEXT_NEW = re.compile(r"\*\*\* (\S+)"), re.compile(r"--- (\S+)")

HUNKS = "array<struct<heading: string, insertions: array<string>, deletions: array<string>, context: array<string>>>"
SCHEMA = f"files array<struct<names: array<string>, similarity: int, hunks: {HUNKS}>>, affected array<string>, lines int, footer int, valid boolean"


class Broken(ValueError):
    """A diff that ends early or has a form that is not read."""


def path_names(old: str, new: str) -> tuple[str, ...]:
    """Both names without .orig and first component, or the one they share; /dev/null stays."""
    bare = [n if n == "/dev/null" else n[n.find("/") + 1 :] for n in (x.removesuffix(".orig") for x in (old, new))]
    return tuple(dict.fromkeys(bare))


class _Cursor:
    def __init__(self, lines: list[str]) -> None:
        self.lines, self.at = lines, 0

    def next(self) -> str:
        if self.at >= len(self.lines):
            raise Broken("the diff ends early")
        self.at += 1
        return self.lines[self.at - 1]

    def left(self) -> int:
        return len(self.lines) - self.at

    def must(self, form: re.Pattern) -> re.Match:
        if not (m := form.match(self.next())):
            raise Broken("another line was due")
        return m


def _hunk(cursor: _Cursor, old: int, new: int) -> tuple[dict[str, list[str]], int]:
    """The lines by their sign until both counts are used up, without blank ones, and how many lines are changed."""
    by_sign: dict[str, list[str]] = {"+": [], "-": [], " ": []}
    changed = 0
    while old or new:
        line = cursor.next()
        sign = " " if not line or line[0].isspace() else line[0]
        if sign not in by_sign:
            continue
        old, new, changed = old - (sign != "+"), new - (sign != "-"), changed + (sign != " ")
        if body := line if line.startswith("\t") else line[1:]:
            by_sign[sign].append(body)
    return by_sign, changed


def _header(cursor: _Cursor) -> tuple[tuple[str, ...], int] | None:
    """The names and the similarity of the next file; junk before it is passed over. None at the end."""
    similarity = 0
    while cursor.left():
        line = cursor.next()
        if m := OLD.match(line):
            return path_names(m[1], cursor.must(NEW)[1]), similarity
        if m := SIMILARITY.match(line):
            similarity = int(m[1])
            if similarity == 100:  # names only, as they are; no hunks follow
                return (cursor.must(RENAME)[1], cursor.must(RENAME)[1]), similarity
    return None


def _weave(old: list[str], new: list[str]) -> list[str]:
    """The two sides of a context hunk as unified lines; a side that is left out has the other's context."""
    if not old:
        old = ["  " + x[2:] for x in new if x[:1] == " "]
    if not new:
        new = ["  " + x[2:] for x in old if x[:1] == " "]
    out, i, j = [], 0, 0
    while i < len(old) or j < len(new):
        if i < len(old) and old[i][:1] in "-!":
            out.append("-" + old[i][2:])
            i += 1
        elif j < len(new) and new[j][:1] in "+!":
            out.append("+" + new[j][2:])
            j += 1
        elif i < len(old) and j < len(new):
            out.append(" " + old[i][2:])
            i, j = i + 1, j + 1
        else:
            raise Broken("the sides of a hunk do not fit")
    return out


def unified(lines: list[str]) -> list[str]:
    """A context diff as a unified one: `*** name` and `--- name` head a file, `***************` a hunk with its two sides."""
    out, at = [], 0
    while at < len(lines):
        head, side = CONTEXT_HEAD.match(lines[at]), at + 1 < len(lines) and CONTEXT_NEW.match(lines[at + 1])
        if head and side and not CONTEXT_FORM.match(lines[at]):
            out += [f"--- {head[1]}", f"+++ {side[1]}"]
            at += 2
        elif lines[at].startswith("*" * 15):
            heading = lines[at][15:].strip()
            sides, starts = [[], []], [0, 0]
            at += 1
            for n, form in enumerate((CONTEXT_FORM, CONTEXT_SIDE)):
                m = form.match(lines[at]) if at < len(lines) else None
                if not m:
                    raise Broken("a hunk without its sides")
                starts[n], at = int(m[1]), at + 1
                while at < len(lines) and lines[at][:2] in ("  ", "- ", "+ ", "! ", ""):
                    sides[n].append(lines[at] or "  ")
                    at += 1
            woven = _weave(*sides)
            size = [sum(x[0] != sign for x in woven) for sign in "+-"]
            out += [f"@@ -{starts[0]},{size[0]} +{starts[1]},{size[1]} @@ {heading}".rstrip(), *woven]
        else:
            out.append(lines[at])
            at += 1
    return out


def parse(lines: list[str] | None) -> dict:
    """A row of SCHEMA. Context diffs are read as unified ones; merge diffs and diffs that end within a hunk are not valid; no diff has no files."""
    cursor, files, total, footer = _Cursor(list(lines) if lines is not None else []), {}, 0, 0
    try:
        if any(MERGE.match(x) for x in cursor.lines[:1]):
            raise Broken("a form that is not read")
        if any(CONTEXT_FORM.match(x) for x in cursor.lines[:10]):
            cursor = _Cursor(unified(cursor.lines))
        while cursor.left():
            footer = cursor.left()
            head = _header(cursor)
            if head is None:
                break
            names, similarity = head
            if similarity == 100:
                files.setdefault(names, (similarity, {}))
                continue
            while cursor.left() and (m := HUNK.match(cursor.lines[cursor.at])):
                cursor.next()
                found, changed = _hunk(cursor, int(m[1] or 1), int(m[2] or 1))
                merged = files.setdefault(names, (similarity, {}))[1].setdefault(m[3], {"+": [], "-": [], " ": []})
                for sign, more in found.items():
                    merged[sign] += more
                total, footer = total + changed, cursor.left()
    except Broken:
        return {"files": None, "affected": None, "lines": None, "footer": None, "valid": False}
    rows = [
        {"names": list(names), "similarity": similarity, "hunks": [{"heading": h, "insertions": x["+"], "deletions": x["-"], "context": x[" "]} for h, x in hunks.items()]}
        for names, (similarity, hunks) in files.items()
    ]
    return {"files": rows, "affected": sorted({n for names in files for n in names} - {"/dev/null"}), "lines": total, "footer": footer, "valid": True}


def parse_diffs(patches: DataFrame, diff: str = "diff", key: str = "id") -> DataFrame:
    """key and SCHEMA's columns; diff is an array of lines."""
    kind = patches.schema[key].dataType.simpleString()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"key": k, **parse(d)} for k, d in zip(frame["key"], frame["diff"], strict=True)]
            yield pd.DataFrame(rows, columns=["key", "files", "affected", "lines", "footer", "valid"], dtype=object)

    rows = patches.select(F.col(key).alias("key"), F.col(diff).alias("diff"))
    return rows.mapInPandas(batches, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
