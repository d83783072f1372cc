"""The most frequent value of a group, in its several meanings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.coerce import col
from sievewright.storage import write_table


def group_mode(df: DataFrame, keys: list[str], values: list[str], tie: str = "first", min_count: int = 1, order: str | None = None) -> DataFrame:
    """(keys, values): for each group of rows with non-null keys, its most frequent non-null value (or tuple of them).

    tie: "first" takes the one that occurs first in `order`, "smallest" the least, "unique" none. A mode that occurs
    fewer than min_count times doesn't count. Groups without a mode have no row. Two levels of aggregation, the first
    combined map-side; the ranking runs over the distinct values of a group only.
    """
    if tie not in ("first", "smallest", "unique"):
        raise ValueError(f"unknown tie rule {tie!r}")
    if tie == "first" and not order:
        raise ValueError("the first value needs an order column")
    some = df
    for k in [*keys, *values]:
        some = some.where(col(k).isNotNull())
    aggs = [F.count("*").alias("__n")] + ([F.min(col(order)).alias("__first")] if tie == "first" else [])
    counts = some.groupBy(*[col(k) for k in [*keys, *values]]).agg(*aggs)
    group = Window.partitionBy(*[col(k) for k in keys])
    by = [F.col("__n").desc(), *([F.col("__first")] if tie == "first" else []), *[col(v) for v in values]]
    best = counts.withColumn("__rank", F.row_number().over(group.orderBy(*by)))
    if tie == "unique":
        best = best.withColumn("__next", F.lead("__n").over(group.orderBy(*by))).where("__next is null or __next < __n")
    return best.where(f"__rank = 1 and __n >= {int(min_count)}").select(*[col(k) for k in [*keys, *values]])


def with_group_mode(df: DataFrame, keys: list[str], values: list[str], cut: bool = False, **kw) -> DataFrame:
    """df with the group's mode in columns <value>__mode; null where there is none or a key is null.

    cut: the modes, few against the rows, are written to the shared folder. In a chain of such steps each would else
    compute all before it twice.
    """
    modes = group_mode(df, keys, values, **kw).select(*[col(k) for k in keys], *[col(v).alias(f"{v}__mode") for v in values])
    modes = write_table(modes, "modes") if cut else modes
    modes = modes.dropDuplicates(keys)  # a row each: known as unique, the join isn't made for those who use other columns
    return df.join(modes, keys, "left").select(*[col(c) for c in df.columns], *[col(f"{v}__mode") for v in values])
