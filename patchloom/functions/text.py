"""Column functions over messages, subjects, headers and paths; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of subjects, ids and archive links, and the trailer names that are known.
SUBJECT_PREFIX = r"^\[.*?\]:? ?(.*)"
MESSAGE_ID = r"(<\S+>)"
SHA = r"([0-9a-f]{5,40})"
ARCHIVE_LINK = r"^https?://(lore|lkml).kernel.org"
TAGS = [
    "Signed-off-by", "Acked-by", "Link", "CC", "Reviewed-by", "Reported-by", "Tested-by", "LKML-Reference", "Patch",
    "Wrecked-off-by", "Gitweb", "Merge", "Fixes", "Commit", "From", "Commit-ID", "Author", "AuthorDate", "Committer",
    "CommitDate", "Suggested-by", "Co-developed-by", "BugLink", "BSpec", "Bugzilla", "Addresses-Coverity",
    "Addresses-Coverity-ID", "Reported-and-tested-by", "Noticed-by", "Message-Id", "Debugged-by", "Depends-on",
    "Coverity-id", "Discussion", "Wearing-brown-paperbag", "References", "OriginalAuthor", "Originally-by",
    "Inspired-by", "Change-Id", "Bug", "Diagnosed-by", "Not-Signed-off-by",
]
#: Letters that are folded in names.
UMLAUTS = ("äöüÄÖÜ", "aouAOU")


def strip_subject(subject: Column) -> Column:
    """The subject without its first [...] prefix; a subject without one stays."""
    return F.when(subject.rlike(SUBJECT_PREFIX), F.regexp_extract(subject, SUBJECT_PREFIX, 1)).otherwise(subject)


def is_revert(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("revert"))


def message_ids(header: Column) -> Column:
    """The set of message ids of a header, in order."""
    return F.array_distinct(F.regexp_extract_all(header, F.lit(MESSAGE_ID), 1))


def repair_message_id(headers: Column) -> Column:
    """The message id of an array of id headers: the longest one, without white space, in angle brackets; NULL where nothing is left of it."""
    longest = F.reduce(headers, F.lit(""), lambda best, x: F.when(F.length(F.coalesce(x, F.lit(""))) > F.length(best), x).otherwise(best))
    bare = F.regexp_replace(longest, r"\s+", "")
    wrapped = F.when(~bare.startswith("<") & ~bare.endswith(">") & (F.length(bare) > 10), F.concat(F.lit("<"), bare, F.lit(">"))).otherwise(bare)
    return F.nullif(F.regexp_extract(wrapped, r"(<.*>)", 1), F.lit(""))


def _tag_pattern() -> str:
    return rf"(?i)^({'|'.join(TAGS)})\s*:\s*(.*)$"


def tag_name(line: Column) -> Column:
    """Lower-cased trailer name of a line such as `Reviewed-by: someone`, NULL for lines without a known trailer."""
    return F.nullif(F.lower(F.regexp_extract(line, _tag_pattern(), 1)), F.lit(""))


def tags(lines: Column) -> Column:
    """Trailers (name, value) of the lines of a message; its first line is never one."""
    pattern = _tag_pattern()
    rest = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.rlike(pattern))
    return F.transform(rest, lambda x: F.struct(F.lower(F.regexp_extract(x, pattern, 1)).alias("name"), F.trim(F.regexp_extract(x, pattern, 2)).alias("value")))


def without_tags(lines: Column) -> Column:
    """A message's lines without trailers and blank lines; the first line stays, and once only if the second repeats it."""
    pattern = _tag_pattern()
    kept = F.filter(lines, lambda x, i: ((i == 0) | ~x.rlike(pattern)) & (F.trim(x) != ""))
    twice = (F.size(kept) > 1) & (F.get(kept, F.lit(0)) == F.get(kept, F.lit(1)))
    return F.when(twice, F.slice(kept, F.lit(2), F.size(kept) - 1)).otherwise(kept)


def archive_links(tags_: Column) -> Column:
    """The values of Link trailers that lead to a mail archive."""
    return F.transform(F.filter(tags_, lambda t: (t["name"] == "link") & t["value"].rlike(ARCHIVE_LINK)), lambda t: t["value"])


def split_footer(lines: Column, footer: Column) -> tuple[Column, Column]:
    """The lines of a diff without its footer, and the footer's `footer` lines."""
    n = F.size(lines) - footer
    return F.slice(lines, F.lit(1), n), F.slice(lines, n + 1, footer)


def normalise_header(value: Column) -> Column:
    """A header in lower case, without line ends, tabs as blanks; empty where there is none."""
    return F.coalesce(F.translate(F.replace(F.lower(value), F.lit("\n"), F.lit("")), "\t", " "), F.lit(""))


def name_pattern(pattern: Column) -> Column:
    """The expression of an N entry: it may match anywhere, and a star at its end says nothing."""
    return F.concat(F.lit(".*"), F.regexp_replace(pattern, r"\*+$", ""), F.lit(".*"))


def day_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def day_of(text: Column) -> Column:
    """The day of a text `YYYY-MM-DD`, NULL for anything else."""
    return F.try_to_date(text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def split_quoted(cell: Column) -> Column:
    """The parts of a cell at commas outside of quotes, without the quotes."""
    return F.transform(F.split(cell, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.btrim(F.trim(x), F.lit('"')))


def label(name: Column) -> Column:
    """A section's name as a label: _ as -, & as AND."""
    return F.replace(F.replace(name, F.lit("_"), F.lit("-")), F.lit("&"), F.lit("AND"))


def render(id_: Column, author: Column, email: Column, date: Column, lines: Column, committer: Column | None = None) -> Column:
    """A patch's message as text under a block of headers; ids in angle brackets are mails."""
    head = F.when(id_.startswith("<"), F.concat(F.lit("Message-ID: "), id_)).otherwise(F.concat(F.lit("Commit:     "), id_))
    parts = [head, F.concat(F.lit("Author:     "), author, F.lit(" <"), email, F.lit(">")), F.concat(F.lit("AuthorDate: "), F.date_format(date, "yyyy-MM-dd HH:mm:ss"))]
    if committer is not None:
        parts.append(F.concat(F.lit("Committer:  "), committer))
    return F.concat_ws("\n", *parts, F.lit(""), F.array_join(lines, "\n"))


def fold(name: Column) -> Column:
    return F.lower(F.replace(F.translate(name, *UMLAUTS), F.lit("ß"), F.lit("ss")))


def decode(raw: Column) -> Column:
    """Bytes as text: UTF-8, or ISO 8859-1 where they are none."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "iso-8859-1"))


def glob_to_regex(pattern: Column) -> Column:
    """An anchored regular expression: * and ? stay within a path component, a trailing / takes everything below."""
    escaped = F.regexp_replace(pattern, r"([.+()\[\]{}|^$])", r"\\$1")
    body = F.replace(F.replace(escaped, F.lit("*"), F.lit("([^/]*)")), F.lit("?"), F.lit("([^/])"))
    return F.concat(F.lit("^"), body, F.when(F.endswith(pattern, F.lit("/")), F.lit(".*")).otherwise(F.lit("")), F.lit("$"))


def sanitise_path(name: Column) -> Column:
    """A diff's file name without .orig and its first component; /dev/null stays."""
    cut = F.regexp_replace(name, r"\.orig$", "")
    return F.when(cut == "/dev/null", cut).otherwise(F.regexp_replace(cut, r"^[^/]*/", ""))


def local_part(address: Column) -> Column:
    return F.split_part(address, F.lit("@"), F.lit(1))


def strip_tld(address: Column) -> Column:
    return F.regexp_replace(address, r"\.[^.]+$", "")


def week(day: Column) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", day))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between timestamps, rounded down: one second back is -1."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000).cast("int")


def is_cherry_pick(line: Column) -> Column:
    low = F.lower(line)
    return low.rlike("pick") | low.rlike("upstream.*commit") | low.rlike("commit.*upstream")


def in_project(affected: Column, dirs: list[str], files: list[str]) -> Column:
    """Every affected file is in a root directory or is a root file; no files are in every project."""
    def ok(x: Column) -> Column:
        test = x.isin(files) if files else F.lit(False)
        for d in dirs:
            test = test | F.startswith(x, F.lit(d))
        return test
    return F.forall(affected, ok)
