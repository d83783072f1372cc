"""Filling nulls from the rows of the same group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions import coerce as c
from sievewright.operators.modes import with_group_mode
from sievewright.roles import Roles


def fill_by_group(df: DataFrame, keys: list[str], target: str, cut: bool = False) -> DataFrame:
    """A null target gets its group's value, if one occurs more than once and more often than any other."""
    wide = with_group_mode(df, keys, [target], tie="unique", min_count=2, cut=cut)
    return wide.withColumn(target, F.coalesce(c.col(target), c.col(f"{target}__mode"))).select(*[c.col(x) for x in df.columns])


def fill_by_location(df: DataFrame, target: str, roles: Roles = Roles(), cut: bool = False) -> DataFrame:
    return fill_by_group(df, [roles.lat, roles.lon], target, cut)


def fill_place_by_zip(df: DataFrame, roles: Roles = Roles(), cut: bool = False) -> DataFrame:
    """Null coordinates get those of the zip's most common pair that occurs more than once, each by itself."""
    wide = with_group_mode(df, [roles.zip], [roles.lat, roles.lon], tie="first", min_count=2, order=roles.row_id, cut=cut)
    filled = {x: F.coalesce(c.col(x), c.col(f"{x}__mode")) for x in (roles.lat, roles.lon)}
    return wide.withColumns(filled).select(*[c.col(x) for x in df.columns])


def fill_category_by_license(df: DataFrame, roles: Roles = Roles(), default: str = "Others", cut: bool = False) -> DataFrame:
    return c.fill_constants(fill_by_group(df, [roles.license], roles.category, cut), {roles.category: default})


def final_cleaning(df: DataFrame, roles: Roles = Roles(), city: str = "Chicago", state: str = "IL") -> DataFrame:
    """Address and zip by location, coordinates by zip, category by licence, alias by name, constants for the rest; rows
    still without coordinates or zip go. The groups' modes are written on the way, see with_group_mode()."""
    df = c.drop_present(df, roles.location)
    df = fill_by_location(df, roles.address, roles, cut=True)
    df = fill_by_location(df, roles.zip, roles, cut=True)
    df = fill_place_by_zip(df, roles, cut=True)
    df = fill_category_by_license(df, roles, cut=True)
    df = c.fill_from(df, roles.alias, roles.name)
    df = c.fill_constants(df, {roles.city: city, roles.state: state})
    df = c.drop_null_rows(df, roles.lat, roles.lon, roles.zip)
    df = c.fill_constants(df, {roles.findings: "0", roles.terms: "0"})
    return c.drop_present(df, roles.entity)
