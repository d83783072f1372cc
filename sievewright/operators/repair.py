"""Repair of nearly functional dependencies by the majority value, with a log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import coerce as c
from sievewright.operators.dependencies import fd_confidence
from sievewright.operators.impute import final_cleaning
from sievewright.roles import Roles
from sievewright.storage import write_table

MAX_RHS = 3


def _targets(df: DataFrame, lhs: list[str], rhs: str, max_rhs: int, order: str) -> DataFrame:
    """(lhs, value, n, majority) of each value (null too) of each group that has 2 to max_rhs different ones.

    The majority is the most frequent value, of equals the one that occurs first in `order`.
    """
    some = df.where(reduce(lambda a, b: a & b, (c.col(k).isNotNull() for k in lhs)))
    counts = some.groupBy(*[c.col(k) for k in lhs], c.col(rhs).alias("__value")).agg(F.count("*").alias("__n"), F.min(c.col(order)).alias("__first"))
    group = Window.partitionBy(*[c.col(k) for k in lhs])
    best = group.orderBy(F.col("__value").isNull(), F.col("__n").desc(), "__first").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = counts.withColumn("__kinds", F.count("__value").over(group)).withColumn("__majority", F.first("__value").over(best))
    return ranked.where(f"__kinds between 2 and {int(max_rhs)}")


def repair_fd(df: DataFrame, lhs: str | list[str], rhs: str, max_rhs: int = MAX_RHS, roles: Roles = Roles(), cut: bool = False) -> tuple[DataFrame, DataFrame]:
    """(repaired rows, log): in groups with 2 to max_rhs right values every row gets the majority, null ones too.

    log: fd, lhs_value, rhs_column, standardised_to, replaced_values (old value -> rows, without nulls) and
    rows_repaired (with them), one row for each group that changes. cut: the values of the groups to be repaired are
    written to the shared folder; rows and log are both made from them.
    """
    keys = [lhs] if isinstance(lhs, str) else list(lhs)
    targets = _targets(df, keys, rhs, max_rhs, roles.row_id)
    targets = write_table(targets, "repairs") if cut else targets
    majority = targets.where("__value <=> __majority").select(*[c.col(k) for k in keys], "__majority")
    joined = df.join(majority.dropDuplicates(keys), keys, "left")  # known as unique, it isn't made for those who use other columns
    fixed = joined.withColumn(rhs, F.coalesce("__majority", c.col(rhs))).select(*[c.col(x) for x in df.columns])
    changed = targets.where("not (__value <=> __majority)")
    old = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("__value").isNotNull(), F.struct(F.col("__value").cast("string").alias("k"), F.col("__n").alias("v"))))))
    log = changed.groupBy(*[c.col(k) for k in keys], "__majority").agg(old.alias("replaced_values"), F.sum("__n").alias("rows_repaired"))
    name = f"{', '.join(keys)} -> {rhs}"
    return fixed, log.select(F.lit(name).alias("fd"), F.concat_ws(", ", *[c.col(k).cast("string") for k in keys]).alias("lhs_value"), F.lit(rhs).alias("rhs_column"), F.col("__majority").cast("string").alias("standardised_to"), "replaced_values", "rows_repaired")


def repair_order(roles: Roles = Roles()) -> list[tuple[str, str]]:
    return [(roles.address, roles.zip), (roles.license, roles.address), (roles.license, roles.zip), (roles.license, roles.risk), (roles.license, roles.category)]


def normalise_texts(df: DataFrame, roles: Roles = Roles(), compat: bool = False) -> DataFrame:
    """Names, address, category and risk without outer blanks in capitals; zips as text (a null as '<NA>' if compat)."""
    texts = [x for x in (roles.name, roles.alias, roles.address, roles.category, roles.risk) if x in df.columns]
    out = df.withColumns({x: c.strip_upper(c.col(x)) for x in texts})
    return out.withColumn(roles.zip, c.zip_text(c.col(roles.zip), compat)) if roles.zip in df.columns else out


def repair_all(df: DataFrame, pairs: list[tuple[str, str]] | None = None, max_rhs: int = MAX_RHS, roles: Roles = Roles(), compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, summary, log): normalise_texts(), then each dependency in order on what the one before left.

    summary: fd, confidence_before, confidence_after, delta, lhs_values_repaired, rows_repaired. Each step
    writes the few values it repairs to the shared folder, so the rows stay one chain of joins with small tables.
    """
    now = write_table(normalise_texts(df, roles, compat), "normalised")  # each step and each confidence reads it
    summaries, logs = [], []
    for lhs, rhs in pairs or repair_order(roles):
        if lhs not in df.columns or rhs not in df.columns:
            continue
        before = now
        now, log = repair_fd(before, lhs, rhs, max_rhs, roles, cut=True)
        logs.append(log)
        a, b = (fd_confidence(x, lhs, rhs).select("confidence") for x in (before, now))
        done = log.agg(F.count("*").alias("lhs_values_repaired"), F.coalesce(F.sum("rows_repaired"), F.lit(0)).alias("rows_repaired"))
        row = a.withColumnRenamed("confidence", "confidence_before").crossJoin(b.withColumnRenamed("confidence", "confidence_after")).crossJoin(done)
        summaries.append(row.select(F.lit(f"{lhs} -> {rhs}").alias("fd"), "confidence_before", "confidence_after", c.half_even(F.col("confidence_after") - F.col("confidence_before"), 4).alias("delta"), "lhs_values_repaired", "rows_repaired"))
    spark = df.sparkSession
    if not logs:
        return now, spark.createDataFrame([], "fd string, confidence_before double, confidence_after double, delta double, lhs_values_repaired bigint, rows_repaired bigint"), spark.createDataFrame([], "fd string, lhs_value string, rhs_column string, standardised_to string, replaced_values map<string,bigint>, rows_repaired bigint")
    return now, reduce(DataFrame.unionByName, summaries), reduce(DataFrame.unionByName, logs)


def repair_and_impute(df: DataFrame, roles: Roles = Roles(), compat: bool = False) -> DataFrame:
    return final_cleaning(repair_all(df, roles=roles, compat=compat)[0], roles)
