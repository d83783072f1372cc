"""Single-column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.coerce import col, half_even, strip_upper_text
from sievewright.functions.text import count_line, stats_line, type_label

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def overview(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))


def _columns(df: DataFrame, *measures: str) -> DataFrame:
    """One row a column, from one pass over the table with an aggregate a column and measure."""
    numeric = {c for c, kind in df.dtypes if kind in _NUMBERS or kind.startswith("decimal")}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        x = col(c)
        d = x.cast("double") if c in numeric else F.lit(None).cast("double")
        make = {"unique_values": F.count_distinct(x), "null_values": F.count_if(x.isNull()), "least": F.min(d), "most": F.max(d), "mean": F.avg(d), "deviation": F.stddev_samp(d)}
        aggs += [make[m].alias(f"{m}_{i}") for m in measures]
    wide = df.agg(*aggs)
    each = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(type_label(kind)).alias("data_type"), *[F.col(f"{m}_{i}").alias(m) for m in measures]) for i, (c, kind) in enumerate(df.dtypes)]
    return wide.select("rows", F.explode(F.array(*each)).alias("c")).select("rows", "c.*")


#: Types whose different values are different texts (but for the zeros of floats, see _summary()).
_PLAIN = ("string", "boolean", "date", "tinyint", "smallint", "int", "bigint", "float", "double")


def _value_table(df: DataFrame) -> DataFrame:
    """(column, value, count) of every value of every column as text, nulls too.

    All columns go through one aggregation with a row a value. A distinct count a column and measure would instead copy
    each row, as wide as the table, once a column, and keep the copies in memory.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in df.columns]))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("count"))


def _summary(df: DataFrame, values: DataFrame) -> DataFrame:
    """(column, data_type, rows, unique_values, null_values), a row a column in their order, from _value_table()."""
    kinds = dict(df.dtypes)
    names = [F.struct(F.lit(c).alias("column"), F.lit(type_label(kind)).alias("data_type"), F.lit(kind in ("float", "double")).alias("__float")) for c, kind in kinds.items()]
    base = df.sparkSession.range(1).select(F.explode(F.array(*names)).alias("c")).select("c.*")
    zeros = F.count_if(F.col("value").isin("0.0", "-0.0"))  # one value
    # every count is above 0: it is read so that this and _top() need the same columns, and the planner aggregates once for both
    found = values.groupBy("column").agg(F.sum("count").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("null_values"), F.count_if(F.col("value").isNotNull() & (F.col("count") > 0)).alias("__texts"), zeros.alias("__zeros"))
    wide = base.join(F.broadcast(found), "column", "left")
    unique = F.col("__texts") - F.when(F.col("__float") & (F.col("__zeros") > 1), 1).otherwise(0)
    odd = [c for c, kind in kinds.items() if kind not in _PLAIN and not kind.startswith("decimal")]
    if odd:  # texts of arrays or times may be the same for different values
        exact = _columns(df.select(*[col(c) for c in odd]), "unique_values").select("column", F.col("unique_values").alias("__exact"))
        wide, unique = wide.join(F.broadcast(exact), "column", "left"), F.coalesce("__exact", unique)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return wide.select("column", "data_type", zero(F.col("rows")).alias("rows"), zero(unique).alias("unique_values"), zero(F.col("null_values")).alias("null_values"))


def _null_pct(digits: int = 2):
    return F.when(F.col("rows") > 0, half_even(F.col("null_values") * 100.0 / F.col("rows"), digits))


def column_summary(df: DataFrame) -> DataFrame:
    """(column, data_type, unique_values, null_values, null_percentage) of every column; null percentage of no rows."""
    return _summary(df, _value_table(df)).select("column", "data_type", "unique_values", "null_values", _null_pct().alias("null_percentage"))


def value_counts(df: DataFrame, top: int = 5) -> DataFrame:
    """(column, value, count, rank): the most frequent values of every column as text, nulls too; ties by value."""
    return _top(_value_table(df), top)


def _top(counts: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc_nulls_last()))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def column_profile(df: DataFrame, many: int = 20, top: int = 5) -> DataFrame:
    """column_summary() with numbers (least, most, mean, deviation) and value_distribution.

    The distribution of a column with more than `many` values is its range if numeric; of any other column its most
    frequent values, a line each.
    """
    values = _value_table(df)  # one shuffle, which the planner reuses
    measures = ("least", "most", "mean", "deviation")
    numbers = [c for c, kind in df.dtypes if type_label(kind) in ("int64", "float64")] or df.columns[:1]
    ends = _columns(df.select(*[col(c) for c in numbers]), *measures).groupBy("column").agg(*[F.first(m).alias(m) for m in measures])  # a row each: known as unique, it isn't made if not used
    summary = _summary(df, values).join(F.broadcast(ends), "column", "left")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", count_line(F.col("value"), F.col("count")).alias("line")))), lambda s: s["line"]), "\n")
    tops = _top(values, top).groupBy("column").agg(lines.alias("lines"))
    wide = summary.join(F.broadcast(tops), "column", "left")  # one row a column
    is_range = (F.col("unique_values") > many) & F.col("data_type").isin("int64", "float64")
    shown = F.when(is_range, stats_line(F.col("least"), F.col("most"), F.col("mean"), F.col("deviation"))).otherwise(F.coalesce("lines", F.lit("No data")))
    return wide.select("column", "data_type", "unique_values", "null_values", _null_pct().alias("null_percentage"), "least", "most", "mean", "deviation", shown.alias("value_distribution"))


def mostly_null(summary: DataFrame, above: float = 50.0) -> DataFrame:
    return summary.where(F.col("null_percentage") > above)


def missing_percentage(df: DataFrame, compat_text: bool = False) -> DataFrame:
    """(column, percentage), the fullest columns first. compat_text: text columns count as full, as stringified."""
    table = df.withColumns({c: strip_upper_text(col(c)) for c, kind in df.dtypes if kind == "string"}) if compat_text else df
    rows = _columns(table, "null_values")
    return rows.select("column", F.when(F.col("rows") > 0, F.col("null_values") * 100.0 / F.col("rows")).alias("percentage")).orderBy("percentage", "column")


def category_distribution(df: DataFrame, column: str, top: int | None = None, missing: str = "MISSING") -> DataFrame | None:
    """(value, count) of a column, the most frequent first; None if the column doesn't exist."""
    if column not in df.columns:
        return None
    out = df.groupBy(F.coalesce(col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "value")
    return out.limit(top) if top else out
