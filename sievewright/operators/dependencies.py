"""Functional dependencies: how far the left side determines the right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.coerce import col, half_even
from sievewright.roles import Roles


def _as_list(x: str | list[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def group_counts(df: DataFrame, lhs: str | list[str], rhs: list[str], drop_null_rhs: bool = False) -> DataFrame:
    """(lhs, rhs, total_groups, violating_groups), a row for each right side, from one shuffle on the left.

    A group violates if its least and greatest value differ: unlike a distinct count, that is combined before the
    shuffle. Null left sides form no group; groups of nulls only count unless drop_null_rhs.
    """
    keys = _as_list(lhs)
    some = df.where(reduce(lambda a, b: a & b, (col(k).isNotNull() for k in keys)))
    ends = [x for i, r in enumerate(rhs) for x in (F.min(col(r)).alias(f"least_{i}"), F.max(col(r)).alias(f"most_{i}"))]
    groups = some.groupBy(*[col(k) for k in keys]).agg(*ends)
    counts = [x for i in range(len(rhs)) for x in (F.count_if(F.col(f"least_{i}").isNotNull() | F.lit(not drop_null_rhs)).alias(f"total_{i}"), F.count_if(F.col(f"least_{i}") != F.col(f"most_{i}")).alias(f"violating_{i}"))]
    wide = groups.agg(*counts)
    rows = [F.struct(F.lit(", ".join(keys)).alias("lhs"), F.lit(r).alias("rhs"), F.col(f"total_{i}").alias("total_groups"), F.col(f"violating_{i}").alias("violating_groups")) for i, r in enumerate(rhs)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _accuracy():
    return F.when(F.col("total_groups") > 0, half_even(1 - F.col("violating_groups") / F.col("total_groups"), 4))


def fd_confidence(df: DataFrame, lhs: str | list[str], rhs: str, empty: float | None = None) -> DataFrame:
    """(lhs, rhs, confidence): the share of groups with one right value at most; `empty` if there is no group."""
    return group_counts(df, lhs, [rhs]).select("lhs", "rhs", F.coalesce(_accuracy(), F.lit(empty)).alias("confidence"))


def discover(df: DataFrame, lhs_columns: list[str], rhs_columns: list[str], ordered: bool = True) -> DataFrame:
    """Every pair of different columns: total_groups, violating_groups, violation_rate and accuracy in percent,
    holds_exactly; those that hold first, then by accuracy. Rows null on either side don't count. One shuffle a left
    column, whatever the number of right ones; without any pair an empty table."""
    lefts = [c for c in lhs_columns if c in df.columns]
    parts = [group_counts(df, c, rest, drop_null_rhs=True) for c in lefts if (rest := [r for r in rhs_columns if r in df.columns and r != c])]
    if not parts:
        return df.sparkSession.createDataFrame([], "lhs string, rhs string, total_groups bigint, violating_groups bigint, violation_rate double, accuracy double, holds_exactly boolean")
    rate = F.when(F.col("total_groups") > 0, half_even(F.col("violating_groups") * 100.0 / F.col("total_groups"), 2))
    out = reduce(DataFrame.unionByName, parts).select("lhs", "rhs", "total_groups", "violating_groups", rate.alias("violation_rate"), half_even(_accuracy() * 100, 2).alias("accuracy"), (F.col("violating_groups") == 0).alias("holds_exactly"))
    return out.orderBy(F.col("holds_exactly").desc(), F.col("accuracy").desc_nulls_last(), "lhs", "rhs") if ordered else out


def detect(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """discover() over the usual candidates of inspection tables."""
    lefts = [roles.license, roles.row_id, roles.address, roles.zip, roles.lat, roles.lon]
    return discover(df, lefts, [roles.name, roles.alias, roles.category, roles.address, roles.city, roles.state, roles.zip, roles.lat, roles.lon])


def nearly_exact(table: DataFrame, least: float = 90.0) -> DataFrame:
    return table.where(F.col("accuracy") >= least)


def chart_pairs(roles: Roles = Roles()) -> list[tuple[str, str]]:
    return [(roles.license, roles.name), (roles.license, roles.address), (roles.license, roles.zip), (roles.license, roles.category), (roles.license, roles.risk), (roles.address, roles.zip)]


def _pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame | None:
    by_left: dict[str, list[str]] = {}
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            by_left.setdefault(a, []).append(b)
    return reduce(DataFrame.unionByName, (group_counts(df, a, bs) for a, bs in by_left.items())) if by_left else None


def confidence_ranking(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame | None:
    """(fd, confidence) of the pairs whose columns exist, the best first; None if there is no such pair."""
    counts = _pairs(df, pairs)
    if counts is None:
        return None
    return counts.select(F.concat_ws(" -> ", "lhs", "rhs").alias("fd"), F.coalesce(_accuracy(), F.lit(0.0)).alias("confidence")).orderBy(F.col("confidence").desc(), "fd")


def violation_counts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame | None:
    """(fd, violating_groups, total_groups) of the pairs whose columns exist, the most violated first."""
    counts = _pairs(df, pairs)
    if counts is None:
        return None
    return counts.select(F.concat_ws(" -> ", "lhs", "rhs").alias("fd"), "violating_groups", "total_groups").orderBy(F.col("violating_groups").desc(), "fd")
