"""Coercions, fills, filters and rates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a typed reader takes for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Blanks of any kind: what Unicode calls white space.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col(name: str) -> Column:
    """The column of exactly this name, dots, blanks and signs included."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing_to_null(df: DataFrame) -> DataFrame:
    """Text that stands for a missing value becomes null, in every text column."""
    return df.withColumns({c: F.when(col(c).isin(*MISSING), None).otherwise(col(c)) for c, kind in df.dtypes if kind == "string"})


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Nulls become the constant, in those of the columns that exist."""
    return df.withColumns({c: F.coalesce(col(c), F.lit(v)) for c, v in values.items() if c in df.columns})


def fill_from(df: DataFrame, target: str, source: str) -> DataFrame:
    return df.withColumn(target, F.coalesce(col(target), col(source)))


def drop_present(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


def drop_null_rows(df: DataFrame, *names: str) -> DataFrame:
    keep = F.lit(True)
    for c in names:
        keep = keep & col(c).isNotNull()
    return df.where(keep)


def drop_equal(df: DataFrame, name: str, value: object) -> DataFrame:
    """Rows with the value go; rows with null stay."""
    return df.where(~col(name).eqNullSafe(F.lit(value)))


def to_number(c: Column) -> Column:
    """A double, or null for what isn't a number; a type suffix (1d, 1f) is no number, and neither is NaN."""
    text = c.cast("string")
    parsed = F.when(text.rlike(r"(?i)[df]\s*$"), None).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(parsed), parsed)


def date_parts(df: DataFrame, source: str, year: str, month: str, day: str, pattern: str = "M/d/yyyy") -> DataFrame:
    """Three ints in place of a text date; null where it isn't one."""
    at = F.try_to_timestamp(col(source).cast("string"), F.lit(pattern))
    return df.withColumns({year: F.year(at), month: F.month(at), day: F.dayofmonth(at)}).drop(source)


def stripped(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.btrim(c, F.lit(BLANKS))  # a pattern would be tried at every sign of the text


def strip_upper(c: Column) -> Column:
    return F.upper(stripped(c))


def strip_upper_text(c: Column) -> Column:
    """As strip_upper, but null becomes the text NAN, as in charts of stringified columns."""
    return F.coalesce(strip_upper(c.cast("string")), F.lit("NAN"))


def stripped_text(c: Column) -> Column:
    """As stripped, but null becomes the text nan."""
    return F.coalesce(stripped(c.cast("string")), F.lit("nan"))


def to_whole(c: Column) -> Column:
    """A bigint, towards zero (60601.7 is 60601); null for what isn't a number or is beyond a bigint, infinity included."""
    return F.coalesce(c.cast("string").try_cast("bigint"), to_number(c).try_cast("bigint"))


def zip_text(c: Column, compat: bool = False) -> Column:
    """A whole number as text; null, and what is no number, is null, or '<NA>' if compat."""
    text = to_whole(c).cast("string")
    return F.coalesce(text, F.lit("<NA>")) if compat else text


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null unless b is positive."""
    return F.when(b > 0, a.cast("double") / b.cast("double"))


def half_even(c: Column, digits: int) -> Column:
    """A double rounded as data frames and SQL do it: what is half even is the product with the power of ten.

    So 0.49374999999999997 is 0.4938, as 0.49375 is: sums of rates that are ties but for their last bit stay ties
    (bround goes by the decimal digits and makes it 0.4937).
    """
    x, scale = c.cast("double"), float(10**digits)
    return F.when(F.abs(x * scale) < float(1 << 52), F.rint(x * scale) / scale).otherwise(x)  # beyond, doubles are whole
