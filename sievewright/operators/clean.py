"""Rule-based cleaning of inspection records: one narrow stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions import coerce as c
from sievewright.functions.text import violation_terms
from sievewright.roles import Roles


def default_license(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """A null licence is licence 0."""
    return df.withColumn(roles.license, F.coalesce(c.col(roles.license), F.lit(0).cast(df.schema[roles.license].dataType)))


def _whole(df: DataFrame, name: str) -> DataFrame:
    """to_whole(), which whole numbers need not go through text for."""
    whole = dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint")
    return df.withColumn(name, c.col(name).cast("bigint") if whole else c.to_whole(c.col(name)))


def clean_inspections(df: DataFrame, roles: Roles = Roles(), default_category: str = "Others", dropped_risk: str = "All") -> DataFrame:
    """The fixed rules, in order: category default; place columns go; rows without zip, licence, kind or risk go, as do
    licence 0 and the catch-all risk; zip and licence become whole numbers, see to_whole() (what isn't one, 1e30 and
    Infinity included, becomes null and stays); the date
    becomes three ints; terms are extracted from the findings.

    It is a projection with filters, so it also runs on streams.
    """
    df = c.fill_constants(df, {roles.category: default_category})
    df = c.drop_present(df, roles.location, roles.city, roles.state)
    df = c.drop_null_rows(df, roles.zip)
    df = _whole(df, roles.zip)
    df = c.drop_null_rows(df, roles.license)
    df = _whole(df, roles.license)
    df = c.drop_equal(df, roles.license, 0)
    df = c.drop_null_rows(df, roles.kind, roles.risk)
    df = c.drop_equal(df, roles.risk, dropped_risk)
    df = c.date_parts(df, roles.date, roles.year, roles.month, roles.day)
    return df.withColumn(roles.terms, violation_terms(c.col(roles.findings)))
