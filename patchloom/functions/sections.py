"""Section files (who maintains which files) to rows; column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Entry lines, addresses, odd spellings of statuses and of two persons.
ENTRY = r"^([A-Z]):\s*(.*)"
TYPO = r"^([A-Z])\t"
MAIL = r"\S+@\S+\.\S+"
STATUSES = {"Odd Fixes (e.g., new signatures)": "odd fixes", "Maintained for 2.6.": "maintained", "Maintained:": "maintained", "Unmaintained": "orphan"}
LOWER_STATUSES = {"buried alive in reporters": "buried", "orphaned": "orphan"}
PERSONS = {"vince bridgers <vbridgers2013@gmail.com": ("vince bridgers", "vbridgers2013@gmail.com"), "florian fainelli <florian.fainelli@broadcom>": ("florian fainelli", "florian.fainelli@broadcom.com")}


def person(value: Column) -> Column:
    """struct(name, mail): `name <mail>` by its last address, a bare address, or a bare name; NULL for anything else with an @."""
    def of(name: Column, mail: Column) -> Column:
        return F.struct(name.alias("name"), mail.alias("mail"))
    named = rf"^(.*)<({MAIL})>"
    out = F.when(value.rlike(named), of(F.btrim(F.trim(F.regexp_extract(value, named, 1)), F.lit('"')), F.regexp_extract(value, named, 2)))
    out = out.when(value.rlike(f"^{MAIL}"), of(F.lit(""), F.regexp_extract(value, f"^({MAIL})", 1))).when(~value.contains("@"), of(value, F.lit("")))
    for odd, (name, mail) in PERSONS.items():
        out = out.when(value == odd, of(F.lit(name), F.lit(mail)))
    return out


def statuses(value: Column) -> Column:
    """The statuses of an S entry in lower case, odd spellings mended, remarks in brackets at the end left out."""
    known = value
    for odd, usual in STATUSES.items():
        known = F.when(value == odd, usual).otherwise(known)
    for odd, usual in LOWER_STATUSES.items():
        known = F.when(F.lower(value) == odd, usual).otherwise(known)
    return F.transform(F.split(F.regexp_replace(known, r"\s*\([^)]*\)\s*$", ""), "/"), lambda x: F.lower(F.trim(x)))


def parse_sections(files: DataFrame, text: str = "text", key: str = "version") -> DataFrame:
    """key, section, pos, kind, value, name, mail: one row per entry.

    Blocks are parted by blank lines; lines before a block's first entry are its
    description, joined by ` / `. Of blocks that share a description the last
    one counts. A block without entries is no section. name and mail are those
    of M, P and R entries, mail alone that of L entries; lists that are web
    addresses are left out. M, P, R and L values are in lower case, S entries
    have a row per status. NULL and empty texts have no sections.
    """
    lines = F.split("block", "\n")
    blocks = files.select(F.col(key).alias("key"), F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n(?:\s*\n)+")).alias("block_no", "block"))
    blocks = blocks.withColumn("lines", F.filter(lines, lambda x: F.trim(x) != "")).withColumn("first", F.array_position(F.transform("lines", lambda x: x.rlike(ENTRY)), F.lit(True)))
    blocks = blocks.filter("first > 0").withColumn("section", F.replace(F.array_join(F.expr("slice(lines, 1, cast(first as int) - 1)"), " / "), F.lit('"'), F.lit("")))
    last = Window.partitionBy("key", "section")
    blocks = blocks.withColumn("last", F.max("block_no").over(last)).filter("block_no = last")
    rows = blocks.select("key", "section", F.posexplode(F.expr("slice(lines, cast(first as int), size(lines))")).alias("pos", "line"))
    line = F.regexp_replace("line", TYPO, "$1:\t")
    rows = rows.select("key", "section", "pos", F.regexp_extract(line, ENTRY, 1).alias("kind"), F.regexp_extract(line, ENTRY, 2).alias("value")).filter("kind <> ''")
    low = F.when(F.col("kind").isin("M", "P", "R", "L"), F.lower("value")).otherwise(F.col("value"))
    rows = rows.withColumn("value", low).filter("not (kind = 'L' and startswith(value, 'http://'))")
    rows = rows.withColumn("value", F.explode(F.when(F.col("kind") == "S", statuses(F.col("value"))).otherwise(F.array("value"))))
    who = F.when(F.col("kind").isin("M", "P", "R"), person(F.col("value")))
    mail = F.when(F.col("kind") == "L", F.nullif(F.regexp_extract("value", f"({MAIL})", 1), F.lit(""))).otherwise(who["mail"])
    return rows.select(F.col("key").alias(key), "section", "pos", "kind", "value", who["name"].alias("name"), mail.alias("mail"))
