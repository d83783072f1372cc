"""From resolved inspections to a dimension and a fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.coerce import col
from sievewright.operators.entity import resolve
from sievewright.roles import Roles
from sievewright.storage import write_table


def numbered(df: DataFrame, name: str, order: list[Column], bucket: Column, counted: DataFrame | None = None) -> DataFrame:
    """df with 1..n in the given order, without one task sorting everything.

    bucket must rise with the order: rows are numbered within their bucket, and a bucket starts after the total of
    those before, which is a running sum over one row a bucket. counted: a cheaper frame with the same rows as far as
    the bucket goes.
    """
    rows = df.withColumn("__bucket", bucket)
    totals = (counted if counted is not None else df).groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("__rows"))
    before = Window.orderBy(F.col("__bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__bucket").alias("__of"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    placed = rows.withColumn("__inside", inside).join(starts, F.col("__bucket").eqNullSafe(F.col("__of")))
    return placed.select((F.col("__start") + F.col("__inside")).alias(name), *[col(x) for x in df.columns])


def merge_back(df: DataFrame, resolved: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Inspections with their entity, and the entity's standard values in place of their own; others unchanged."""
    std = [f"{x}_std" for x in roles.standard]
    wide = df.join(resolved.select(*[col(k) for k in roles.key], *[col(x) for x in std], col(roles.entity)), roles.key, "left")
    out = {x: F.when(col(roles.entity).isNotNull(), col(f"{x}_std")).otherwise(col(x)) for x in roles.standard}
    return wide.withColumns(out).select(*[col(x) for x in df.columns], col(roles.entity))


def entity_table(merged: DataFrame, roles: Roles = Roles(), id_name: str = "restaurant_id") -> DataFrame:
    """(restaurant_id, entity_id, attributes): the first row of each entity, numbered by entity id; null entities last."""
    columns = [x for x in (roles.license, roles.name, roles.alias, roles.category, roles.address, roles.city, roles.state, roles.zip, roles.lat, roles.lon) if x in merged.columns]
    first = Window.partitionBy(col(roles.entity)).orderBy(col(roles.row_id))
    one = write_table(merged.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").select(col(roles.entity), *[col(x) for x in columns]), "entities")
    return numbered(one, id_name, [col(roles.entity).asc_nulls_last()], F.substring(col(roles.entity), 1, 4))


def inspection_table(merged: DataFrame, entities: DataFrame, roles: Roles = Roles(), id_name: str = "restaurant_id", own_id: str = "inspection_no", bucket_rows: int = 1_000_000) -> DataFrame:
    """(inspection_no, restaurant_id, facts): every inspection, numbered in row order, with its entity's number."""
    facts = [x for x in (roles.kind, roles.risk, roles.result, roles.findings, roles.terms, roles.year, roles.month, roles.day) if x in merged.columns]
    ids = entities.select(col(roles.entity).alias("__entity"), id_name)
    wide = merged.join(ids, col(roles.entity).eqNullSafe(F.col("__entity")), "left").select(col(roles.row_id).alias("__row"), id_name, *[col(x) for x in facts])
    return numbered(wide, own_id, [F.col("__row")], F.floor(F.col("__row") / bucket_rows), merged.select(col(roles.row_id).alias("__row"))).drop("__row")


def structure(df: DataFrame, roles: Roles = Roles()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged inspections, entity table without the entity id, inspection table)."""
    merged = write_table(merge_back(df, resolve(df, roles=roles), roles), "merged")
    entities = entity_table(merged, roles)
    return merged, entities.drop(roles.entity), inspection_table(merged, entities, roles)
