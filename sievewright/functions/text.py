"""Coded terms in free text, labels and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions.coerce import stripped

#: Where a clause's remarks begin: of these, the first in this order that occurs at all.
MARKERS = (" - Comments:", "Comments:", " - ", "COMMENTS:")

#: The number, within a bigint, that a clause begins with, where no marker cuts it short and more than blanks follows. If
#: there are as many as clauses, they are all terms, and no clause need be looked at by itself.
_ALL_FIRST = r"(?U)(?:^|\|)\s*([0-9]{1,18})\.(?! - )\s(?=\s*[^\s|])"


def _before_remarks(clause: Column) -> Column:
    out = clause
    for marker in reversed(MARKERS):
        out = F.when(clause.contains(marker), F.substring_index(clause, marker, 1)).otherwise(out)
    return out


def term_list(text: Column) -> Column:
    """Numbers of the clauses of a text (divided by |), without leading zeros, once each, in numeric order.

    A clause has the number that it begins with, else all numbers that are followed by a dot and a capital.
    """

    def first(head: Column) -> Column:
        return F.struct(head.alias("head"), F.regexp_extract(head, r"(?U)^\s*(\d+)\.\s", 1).alias("first"))

    def numbers(s: Column) -> Column:
        return F.when(s["first"] != "", F.array(s["first"])).otherwise(F.regexp_extract_all(s["head"], F.lit(r"(?U)\b(\d+)\.\s+[A-Z]"), F.lit(1)))

    clauses = F.transform(F.split(text, r"\|", -1), stripped)  # a step at a time: what a function uses twice is worked out once
    found = F.flatten(F.transform(F.transform(F.transform(clauses, _before_remarks), first), numbers))
    clean = F.transform(found, lambda x: F.regexp_replace(x, r"^0+(?=\d)", ""))
    by_number = F.transform(F.sort_array(F.transform(F.array_distinct(clean), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda s: s["x"])
    count = F.length(text) - F.length(F.replace(text, F.lit("|"))) + 1
    quick = F.array(F.regexp_extract_all(text, F.lit(_ALL_FIRST), F.lit(1)))
    return F.transform(quick, lambda q: F.when(F.size(q) == count, F.sort_array(F.array_distinct(q.cast("array<bigint>"))).cast("array<string>")).otherwise(by_number))[0]


def violation_terms(text: Column) -> Column:
    """term_list() joined by commas; null for a null text or one without terms."""
    return F.nullif(F.array_join(term_list(text), ","), F.lit(""))  # a CASE would work the list out twice


def parsed_terms(text: Column) -> Column:
    """The whole numbers in a comma-separated list; fractions are cut, zeros and anything else left out, repeats kept."""

    text = F.coalesce(text, F.lit(""))
    plain = F.transform(F.split(text, ","), lambda p: p.cast("bigint"))
    parts = F.transform(F.split(text, ","), stripped)
    doubles = F.transform(parts, lambda p: F.when(p.rlike(r"(?i)[df]\s*$"), None).otherwise(p.try_cast("double")))
    values = F.transform(doubles, lambda v: F.when(F.abs(v) < 1e18, v.cast("bigint")))
    return F.filter(F.when(text.rlike(r"^[0-9]{1,15}(,[0-9]{1,15})*\z"), plain).otherwise(values), lambda v: v.isNotNull() & (v != 0))


def normalized_name(name: Column) -> Column:
    """Capitals and digits alone; '' for null."""
    return F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9]", "")


def set_text(items: Column) -> Column:
    return F.array_join(F.array_sort(items), ", ")


def count_line(value: Column, count: Column) -> Column:
    """'value: 1,234', the value cut to 30 signs, NaN for null."""
    text = F.coalesce(value.cast("string"), F.lit("NaN"))
    short = F.when(F.length(text) > 30, F.concat(F.substring(text, 1, 27), F.lit("..."))).otherwise(text)
    return F.concat(short, F.lit(": "), F.format_string("%,d", count))


def stats_line(least: Column, most: Column, mean: Column, deviation: Column) -> Column:
    """Cosmetic: the numbers themselves are columns of their own in profiles."""
    return F.format_string("Range: [%.2f, %.2f], Mean: %.2f, Std: %.2f", *[c.cast("double") for c in (least, most, mean, deviation)])


def type_label(kind: str) -> str:
    """The name that data frames of Python use for a Spark type."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "int64"
    if kind in ("float", "double") or kind.startswith("decimal"):
        return "float64"
    return {"boolean": "bool", "timestamp": "datetime64[ns]", "date": "datetime64[ns]"}.get(kind, "object")


def slug(title: str) -> str:
    """A title as part of a file name."""
    return title.lower().replace(" ", "_").replace("#", "num")
