"""Similarities, distances and levels of agreement as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in km.
EARTH_KM = 6371.0088
CELL = 0.25


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays, 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda x, y: F.pow(F.sin((F.radians(y) - F.radians(x)) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)))) * (2 * EARTH_KM)


def cell(x: Column) -> Column:
    """Lower edge of the grid cell that holds a coordinate."""
    return F.round(F.floor(x / F.lit(CELL)) * F.lit(CELL), 4)


def stepped(value: Column, cuts: list[tuple[float, int]], missing: int = -1, at_least: bool = True) -> Column:
    """Level of a value by its cuts, first hit wins; `missing` for null and 0 beyond the last cut."""
    out = F.when(value.isNull(), missing)
    for cut, level in cuts:
        out = out.when(value >= cut if at_least else value <= cut, level)
    return out.otherwise(0)


def lexical_score(jw: Column, tokens: Column) -> Column:
    return F.greatest(jw, tokens) * 0.65 + F.least(jw, tokens) * 0.35


def lexical_level(score: Column) -> Column:
    return stepped(score, [(0.94, 3), (0.86, 2), (0.74, 1)])


def phonetic_level(a: Column, b: Column) -> Column:
    """-1 if a side has no token, else 2, 1 or 0 for two or more, one or no shared tokens."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), -1).otherwise(F.least(F.size(F.array_intersect(a, b)), F.lit(2)))


def name_level(phonetic: Column, same_key: Column, lexical: Column) -> Column:
    return (
        F.when(phonetic == 2, 5).when(phonetic == -1, 4).when((phonetic == 1) & same_key, 3).when(phonetic == 1, 2)
        .when(lexical >= 0.70, 1).otherwise(0)
    )


def temporal_level(a: Column, b: Column) -> Column:
    """Levels of the distance between two implied birth years."""
    return stepped(F.abs(a - b), [(1, 2), (2, 1)], at_least=False)


def spatial_level(hops: Column, km: Column) -> Column:
    near = lambda h, d: (hops <= h) | F.coalesce(km <= d, F.lit(False))
    return F.when(hops == 0, 3).when(near(2, 15), 2).when(near(4, 60), 1).otherwise(0)


def implied_birth_year(day: Column, age: Column) -> Column:
    """Year of the record less the age; null where the age is blank or no number."""
    return F.year(day) - age.try_cast("double")


def hops(a: Column, b: Column) -> Column:
    """Steps between two units over their nearest common superior, from their paths (root first); null without one."""
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")))["n"]
    return F.when(common > 0, F.size(a) + F.size(b) - 2 * common)


def gender_level(a: Column, b: Column) -> Column:
    """2 for equal, 0 for different, -1 where one is unknown; level 1 is kept for uncertain records."""
    return F.when(a.isNull() | b.isNull(), -1).otherwise((a == b).cast("int") * 2)


def modus_level(cosine: Column) -> Column:
    return stepped(cosine, [(0.55, 3), (0.35, 2), (0.18, 1)])


def relational_level(computable: Column, shared: Column, same_officer: Column) -> Column:
    return F.when(~computable, -1).when(shared, 2).when(same_officer, 1).otherwise(0)


def address_level(a: Column, b: Column) -> Column:
    """2 for equal addresses, 1 for equal text before the first comma, -1 if a side is blank."""
    stem = lambda x: F.lower(F.trim(F.substring_index(x, ",", 1)))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    return F.when(blank(a) | blank(b), -1).when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 2).when(stem(a) == stem(b), 1).otherwise(0)


def phone_level(a: Column, b: Column) -> Column:
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    return F.when(blank(a) | blank(b), -1).otherwise((F.trim(a) == F.trim(b)).cast("int"))
