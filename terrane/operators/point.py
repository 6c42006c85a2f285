"""Signatures of points: the fields of the smallest covering unit, grouped by band, as a summary and as a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalars import relief_position
from terrane.operators import geometry

#: A band: its letter, label, and fields as (key, label).
Bands = dict[str, tuple[str, list[tuple[str, str]]]]


def point_signature(points: DataFrame, units: DataFrame, point: str, unit: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """One row for each point (point, lat, lon and whatever it brings along) in a unit: the point's columns, unit, and all columns
    of the smallest unit (ring or shape) that covers it; points outside all units have no row. With ``low`` and ``high``, the
    unit's least and greatest elevation, and a column ``elev_point``, relief_range and relief_position are added."""
    at = geometry.smallest_cover(points.select(point, "lat", "lon"), units, "lon", "lat", point, unit)
    fields = units.drop("ring", "shape")
    out = points.join(at, point).join(fields, unit)
    if low and high:
        out = out.withColumn("relief_range", F.col(high) - F.col(low)).withColumn("relief_position", relief_position(F.col("elev_point"), F.col(low), F.col(high)))
    return out


def _value(df: DataFrame, key: str) -> tuple[Column, Column]:
    """A field as text and, if it is one, as a number; the other is null."""
    text = dict(df.dtypes)[key] == "string"
    none = lambda kind: F.lit(None).cast(kind)
    return (F.col(key), none("double")) if text else (none("string"), F.col(key).cast("double"))


def banded(signature: DataFrame, point: str, bands: Bands) -> DataFrame:
    """point, band, label, items: each band's fields that the signature has, in order, as structs (key, label, text, number)."""
    def items(fields: list[tuple[str, str]]) -> Column:
        some = [(k, name) for k, name in fields if k in signature.columns]
        rows = [F.struct(F.lit(k).alias("key"), F.lit(name).alias("label"), *(v.alias(n) for v, n in zip(_value(signature, k), ("text", "number"), strict=True))) for k, name in some]
        return F.array(*rows)

    rows = [F.struct(F.lit(letter).alias("band"), F.lit(label).alias("label"), items(fields).alias("items")) for letter, (label, fields) in bands.items() if any(k in signature.columns for k, _ in fields)]
    return signature.select(point, F.inline(F.array(*rows)))


def summary(signature: DataFrame, point: str, fields: list[tuple[str, str]]) -> DataFrame:
    """point, place, key, label, text, number: the fields of a quick reading in their order; unknown fields are left out."""
    some = [(k, name) for k, name in fields if k in signature.columns]
    rows = [F.struct(F.lit(i).alias("place"), F.lit(k).alias("key"), F.lit(name).alias("label"), *(v.alias(n) for v, n in zip(_value(signature, k), ("text", "number"), strict=True))) for i, (k, name) in enumerate(some, 1)]
    return signature.select(point, F.inline(F.array(*rows)))


def digest(signature: DataFrame, point: str, title: Column, bands: Bands, places: dict[str, int] | None = None) -> DataFrame:
    """point, digest: a title, then a line for each band and, below it, one for each field; numbers to ``places`` (0 if not told),
    n/a for what is unknown."""
    def shown(key: str) -> Column:
        text, number = _value(signature, key)
        n = (places or {}).get(key, 0)
        plain = F.round(number, n).cast(f"decimal(38,{n})").cast("string")
        return F.coalesce(text, plain, F.lit("n/a"))

    lines: list[Column] = [title]
    for letter, (label, fields) in bands.items():
        some = [(k, name) for k, name in fields if k in signature.columns]
        if some:
            lines += [F.lit(f"{letter}: {label}"), *(F.concat(F.lit(f"  {name}: "), shown(k)) for k, name in some)]
    return signature.select(point, F.array_join(F.array(*lines), "\n").alias("digest"))


def nearest_cells(queries: DataFrame, cells: DataFrame, query: str) -> DataFrame:
    """query, cell_lat, cell_lon: the nearest row and column of a regular grid, each by itself, ties to the smaller; longitudes count
    from 0 to 360. ``cells`` has lat and lon; its axes, a few thousand values each, are one broadcast row."""
    axes = F.broadcast(cells.agg(F.sort_array(F.collect_set("lat")).alias("_lats"), F.sort_array(F.collect_set("lon")).alias("_lons")))
    nearest = lambda axis, x: F.array_min(F.transform(axis, lambda a: F.struct(F.round(F.abs(a - x), 9).alias("d"), a.alias("at"))))["at"]
    east = F.pmod(F.col("lon"), F.lit(360.0))
    return queries.join(axes).select(query, nearest("_lats", F.col("lat")).alias("cell_lat"), nearest("_lons", east).alias("cell_lon"))


def grid_series(queries: DataFrame, runs: DataFrame, query: str, first: int, last: int) -> DataFrame:
    """query, cell_lat, cell_lon, year, mean, spread over the members of an ensemble (lat, lon, year, member, value) at each query's
    nearest cell, for years from ``first`` to ``last``; the spread is the population deviation, 0 for one member."""
    at = nearest_cells(queries, runs.select("lat", "lon").distinct(), query)
    some = runs.where(F.col("year").between(first, last)).groupBy(F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"), "year").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
    return at.join(some, ["cell_lat", "cell_lon"]).select(query, "cell_lat", "cell_lon", "year", "mean", "spread")
