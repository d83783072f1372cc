"""Likeness of names, places, codes and categories."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions.coerce import stripped

EARTH_M = 6_371_000.0
#: Parts of the score: name, zip, place, category; and the score from which two rows are one entity.
WEIGHTS = (0.55, 0.2, 0.2, 0.05)
THRESHOLD = 0.5


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(EARTH_M) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def distance_similarity(metres: Column) -> Column:
    """1 at the spot, falling in steps and curves to 0 from 5 km."""
    d = metres
    return F.when(d == 0, 1.0).when(d <= 100, 0.9).when(d <= 500, 0.9 - 0.3 * (d - 100) / 400).when(d <= 5000, 0.6 * F.pow((5000 - d) / 4500, 2)).otherwise(0.0)


def place_similarity(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """0 unless all are known; less than 0.1 m is no distance."""
    return nearness(haversine(lat1, lon1, lat2, lon2))


def nearness(d: Column) -> Column:
    """place_similarity() by the metres, null if a place isn't known. They are used many times: make them a column."""
    return F.when(d.isNotNull(), distance_similarity(F.when(d < 0.1, 0.0).otherwise(d))).otherwise(0.0)


def same_code(a: Column, b: Column) -> Column:
    return F.when(a.cast("string") == b.cast("string"), 1.0).otherwise(0.0)


def same_category(a: Column, b: Column) -> Column:
    return same_text(*(F.lower(stripped(c)) for c in (a, b)))


def same_text(x: Column, y: Column) -> Column:
    return F.when((x == y) & (x != ""), 1.0).otherwise(0.0)


def _places(a: str) -> dict[str, int]:
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    return where


def lcs_length(a: str, b: str, where: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a machine word's worth of rows at a time (Hyyro 2004).

    where: _places(a), if a is compared with many."""
    where = _places(a) if where is None else where
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        if at := where.get(ch):
            u = s & at
            s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _ratio(x: str, y: str, where: dict[str, int] | None = None) -> float:
    if not x or not y:
        return 0.0
    n = min(len(x), len(y)) if y.startswith(x) or x.startswith(y) else lcs_length(x, y, where)
    return round(100 * (2 * n / (len(x) + len(y)))) / 100


def name_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whole percents of 2 LCS / total length, as a fraction, for normalised names; 0 if either is empty."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def name_ratio(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(name_ratios, "double")(a, b)


def _ratio_lists(names: pa.Array) -> pa.Array:
    flat, lengths, out, offsets = names.flatten().to_pylist(), pc.list_value_length(names).to_pylist(), [], [0]
    at = 0
    for n in lengths:
        for i in range(at, at + n - 1):
            x, where = flat[i], _places(flat[i])
            out += [_ratio(x, y, where) for y in flat[i + 1 : at + n]]
        at += n
        offsets.append(len(out))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out, pa.float64()))


def ratio_list(names: Column) -> Column:
    """The ratios of each two names of a list: of the first with each after it, of the second with each after it, and so on."""
    return F.arrow_udf(_ratio_lists, "array<double>")(names)


def score(name: Column, code: Column, place: Column, category: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    """The weighted sum, added up from left to right."""
    return F.lit(weights[0]) * name + F.lit(weights[1]) * code + F.lit(weights[2]) * place + F.lit(weights[3]) * category
