"""Mails to patches: payload, message, annotation and diff, recipients, date.

MIME trees have no form in SQL, so raw mails go through Arrow batches; a batch
holds whole mails and nothing is kept between them.
"""

from __future__ import annotations

import email
import email.utils
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from email.charset import CHARSETS
from email.message import Message

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What begins a diff, what parts a message from its annotation, what counts as an address.
DIFF_START = re.compile(r"diff |--- \S+/.+$|(?i:index: )")
SEPARATOR = re.compile(r"---\s*$")
ADDRESS = re.compile(r".+@.+\..+")
ATTACHED_DIFF = re.compile(r"^(diff --|Index: )", re.MULTILINE)
BARE_DIFF = re.compile(r"---.*\n\+\+\+.*\n.*")

SCHEMA = (
    "message_id string, subject string, author_name string, author_email string, date timestamp, recipients array<string>, "
    "message array<string>, annotation array<string>, diff array<string>, valid boolean"
)
EPOCH = datetime.fromtimestamp(0, UTC)


def split_message(text: str | None) -> tuple[list[str], list[str] | None, list[str]] | None:
    """Message, annotation (None without a --- line) and diff; None for a text without a diff, empty ones included."""
    lines = (text or "").replace("\f", " ").splitlines()
    lines = lines[1:] if lines and lines[0].startswith("--") else lines
    diff = next((i for i, x in enumerate(lines) if DIFF_START.match(x)), None)
    if diff is None:
        return None
    mark = next((i for i in range(diff) if SEPARATOR.match(lines[i])), None)
    if mark is None:
        return lines[:diff], None, lines[diff:]
    return lines[:mark], lines[mark + 1 : diff], lines[diff:]


def _decoded(part: Message) -> str:
    codec, data = part.get_content_charset(), part.get_payload(decode=True)
    return (data or b"").decode(codec if codec in CHARSETS else "ascii", "ignore")


def _nested(text: str) -> Message | None:
    """The mail that an attachment is, as a formatted patch: without defects and with a sender."""
    mail = email.message_from_string(text)
    return mail if "From" in mail and not mail.defects else None


def payload(mail: Message) -> tuple[Message, str] | None:
    """The mail that holds the patch and its text: the body, an attached mail, texts before diffs, or the first part that looks like one."""
    body = _decoded(mail)
    if body or not mail.is_multipart():
        return mail, body or str(mail.get_payload() or "")
    texts = [t for t in map(_decoded, mail.get_payload()) if t]
    for inner in filter(None, map(_nested, texts)):
        return inner, _decoded(inner)
    is_diff = [bool(ATTACHED_DIFF.search(t) or BARE_DIFF.match(t)) for t in texts]
    if len(texts) > 1 and any(is_diff):
        ordered = sorted(zip(is_diff, texts, strict=True), key=lambda x: x[0])
        return mail, "".join(f"{t}\n" for _, t in ordered) + "\n"
    return next(((mail, t) for t in texts if "From: " in t or "diff --" in t), None)


def read_date(header: str | None) -> datetime | None:
    """The date of a header, UTC where it names no zone: as mails write it, else as ISO 8601; NULL for anything else and for years before 1970."""
    text = " ".join(str(header or "").split())
    for read in (email.utils.parsedate_to_datetime, datetime.fromisoformat, lambda x: datetime.strptime(x, "%a %b %d %H:%M:%S %Y")):
        try:
            date = read(text)
        except (TypeError, ValueError, IndexError, OverflowError):
            continue
        date = date.astimezone(UTC) if date.tzinfo else date.replace(tzinfo=UTC)
        return date if date.year >= 1970 else None
    return None


def parse_date(header: str | None) -> datetime:
    """The date of a header; the epoch for what is no date."""
    return read_date(header) or EPOCH


def mail_date(mail: Message) -> datetime | None:
    """The day of a mail that is to be filed: of its Date, of that with dots for colons in its time, of NNTP-Posting-Date or of the last Received; NULL where none can be read."""
    last = lambda name: (mail.get_all(name) or [""])[-1]
    date = str(last("Date"))
    tries = [date, re.sub(r"(.*)\s(.*)\.(.*)\.(.*)\s(.*)", r"\1 \2:\3:\4 \5", " ".join(date.split())), str(last("NNTP-Posting-Date")), str(last("Received")).rpartition(";")[2]]
    return next((found for t in tries if (found := read_date(t))), None)


def file_mails(mails: DataFrame, raw: str = "raw") -> DataFrame:
    """(day, md5, location, raw): every mail that has a date once, to be filed under YYYY/MM/DD/md5; the rest have no place."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            days = [mail_date(email.message_from_bytes(bytes(r or b""))) for r in frame["raw"]]
            yield pd.DataFrame({"day": [d and d.date() for d in days], "raw": frame["raw"]})

    rows = mails.select(F.col(raw).cast("binary").alias("raw")).filter("raw is not null").mapInPandas(batches, "day date, raw binary").filter("day is not null")
    named = rows.withColumn("md5", F.md5("raw"))
    # Equal mails are told by their hash before any text is moved.
    return named.dropDuplicates(["md5"]).select("day", "md5", F.concat_ws("/", F.date_format("day", "yyyy/MM/dd"), "md5").alias("location"), "raw")


def recipients(mail: Message) -> list[str]:
    """Valid addresses of To and Cc, in lower case, sorted, each once."""
    headers = [str(x) for name in ("To", "Cc") for x in mail.get_all(name, []) if x]
    return sorted({address.lower() for _, address in email.utils.getaddresses(headers) if ADDRESS.match(address)})


def parse(raw: bytes | None) -> dict:
    """One mail as a row of SCHEMA; without a patch or with a broken tree it is not valid and its lists are NULL."""
    mail = email.message_from_bytes(bytes(raw or b""))
    row = {"message_id": mail["Message-ID"] and str(mail["Message-ID"]), "date": parse_date(mail["Date"]), "recipients": recipients(mail), "valid": False}
    try:
        found = payload(mail)
        parts = found and split_message(found[1])
    except (LookupError, ValueError, AttributeError, TypeError):
        found = parts = None
    source = found[0] if found else mail
    subject = source["Subject"]
    row["author_name"], row["author_email"] = email.utils.parseaddr(str(source["From"] or ""))
    row["subject"] = None if subject is None else str(subject)
    if parts and subject is not None:
        plain = re.match(r"\[.*?\]:? ?(.*)", row["subject"])
        message, annotation, diff = parts
        row |= {"message": [plain[1] if plain else row["subject"], "", *message], "annotation": annotation, "diff": diff, "valid": True}
    return {k: v.encode("utf-8", "replace").decode() if isinstance(v, str) else v for k, v in row.items()}


def parse_mails(mails: DataFrame, raw: str = "raw", key: str = "id") -> DataFrame:
    """key and SCHEMA's columns for every row; a NULL mail is an empty one."""
    kind = mails.schema[key].dataType.simpleString()
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(", ")]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [dict.fromkeys(names) | {"key": k} | parse(r) for k, r in zip(frame["key"], frame["raw"], strict=True)]
            out = pd.DataFrame(rows, columns=["key", *names], dtype=object)
            out["date"] = pd.to_datetime(out["date"], utc=True)
            yield out

    rows = mails.select(F.col(key).alias("key"), F.col(raw).cast("binary").alias("raw"))
    return rows.mapInPandas(batches, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)
