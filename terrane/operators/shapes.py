"""Areas of any form: parts, holes, outlines that are not convex; their sizes and overlaps on the sphere.

A shape is an array of parts, a part an array of rings, a ring an array of struct(x, y) in degrees; the first ring of a part is its
outer one, the others are holes. Which way round a ring runs and whether its last point repeats the first doesn't matter. Edges
are straight in longitude and latitude. A frame has a column ``shape``, or ``ring`` for single rings without holes.

Nothing is clipped. A shape is the signed sum of the strips below its edges: +1 below an upper edge, -1 below a lower one. So the
overlap of two shapes is a sum over pairs of one's edges with the other's of the strip below both, each pair's integral being
exact: joins and sums only, whatever the forms are, and edges that touch or coincide need no case of their own. Edges are cut
at columns of longitude and meet by an equi-join on (shape, column), so an outline of any length is dealt over tasks. Columns
turn with the globe: a shape may reach beyond 180 degrees, and one that holds a pole has an edge along its latitude.

Defined cases: null shapes, and rings of fewer than three points or with null coordinates, have no area; a shape that crosses itself
counts areas as often as it winds around them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.scalars import EARTH_KM

#: Degrees of a column of longitude and of a row of latitude; 180 must be a multiple.
COLUMN, ROW = 5.0, 5.0
#: Overlaps up to this are sums of rounding errors: a square metre.
NOISE_KM2 = 1e-6

_POINT = "array<struct<x:double,y:double>>"


def shape_of(ring: Column) -> Column:
    """The shape of one ring without holes."""
    return F.array(F.array(ring))


def with_shape(df: DataFrame) -> DataFrame:
    """``df`` with a column ``shape``, made of ``ring`` where it has none."""
    return df if "shape" in df.columns else df.withColumn("shape", shape_of(F.col("ring")))


def following(ring: Column) -> Column:
    """The ring from its second point, closed."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, F.lit(1), F.lit(1)))


def _turn(ring: Column) -> Column:
    """1 for a ring that runs counter-clockwise, -1 for clockwise, 0 without area. Coordinates count from the first point."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    twice = F.zip_with(ring, following(ring), lambda a, b: (a["x"] - ox) * (b["y"] - oy) - (b["x"] - ox) * (a["y"] - oy))
    return F.signum(F.aggregate(twice, F.lit(0.0), lambda s, v: s + v))


def square_degrees(shape: Column) -> Column:
    """Planar size: outer rings less holes."""
    twice = lambda r: F.abs(F.aggregate(F.zip_with(r, following(r), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v))
    of_part = lambda part: F.aggregate(F.transform(part, lambda r, k: twice(r) * F.when(k == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(F.transform(shape, of_part), F.lit(0.0), lambda s, v: s + v) / 2


def rings(df: DataFrame, key: str) -> DataFrame:
    """(key, ring, hole) of every ring that can have an area."""
    parts = with_shape(df).select(key, F.explode(F.col("shape").cast(f"array<array<{_POINT}>>")).alias("_part"))
    some = parts.select(key, F.posexplode("_part").alias("_no", "ring")).where("size(ring) >= 3")
    whole = ~F.exists("ring", lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull())
    return some.where(whole).select(key, "ring", (F.col("_no") > 0).alias("hole"))


def edges(df: DataFrame, key: str) -> DataFrame:
    """(key, x0, y0, x1, y1, sign) of edges that are not vertical, x0 < x1: sign is 1 if the shape lies below, -1 if above."""
    turned = rings(df, key).select(key, "ring", (_turn(F.col("ring")) * F.when(F.col("hole"), -1.0).otherwise(1.0)).alias("_turn"))
    pair = turned.select(key, "_turn", F.explode(F.arrays_zip(F.col("ring").alias("p"), following(F.col("ring")).alias("q"))).alias("_e"))
    right = F.col("_e.q.x") > F.col("_e.p.x")
    ends = lambda c: [F.when(right, F.col(f"_e.p.{c}")).otherwise(F.col(f"_e.q.{c}")).alias(f"{c}0"), F.when(right, F.col(f"_e.q.{c}")).otherwise(F.col(f"_e.p.{c}")).alias(f"{c}1")]
    return pair.where("_e.p.x <> _e.q.x AND _turn <> 0").select(key, *ends("x"), *ends("y"), F.when(right, -F.col("_turn")).otherwise(F.col("_turn")).alias("sign"))


def _mean_sine(p: Column, q: Column) -> Column:
    """Mean of sin(latitude) along an edge whose latitude runs evenly from p to q degrees."""
    h = F.radians(q - p) / 2
    flat = F.abs(h) < 1e-4
    return F.sin(F.radians(p + q) / 2) * F.when(flat, 1 - h * h / 6).otherwise(F.sin(h) / F.when(flat, F.lit(1.0)).otherwise(h))


def areas(df: DataFrame, key: str) -> DataFrame:
    """(key, km2) of shapes with an area."""
    strip = F.col("sign") * F.radians(F.col("x1") - F.col("x0")) * _mean_sine(F.col("y0"), F.col("y1"))
    return edges(df, key).groupBy(key).agg((F.sum(strip) * EARTH_KM**2).alias("km2")).where(F.col("km2") > NOISE_KM2)


def _columns(df: DataFrame, key: str, width: float) -> DataFrame:
    """Edges cut at columns: (key, column, xa, ya, xb, yb, sign), with longitudes turned to the column's place on the globe."""
    e = edges(df, key).withColumn("_k", F.explode(F.sequence(F.floor(F.col("x0") / width), F.ceil(F.col("x1") / width) - 1)))
    lo, hi = F.greatest(F.col("x0"), F.col("_k") * width), F.least(F.col("x1"), (F.col("_k") + 1) * width)
    e = e.select("*", lo.alias("_lo"), hi.alias("_hi"), (F.floor((F.col("_k") * width + 180) / 360) * 360.0).alias("_turns")).where("_lo < _hi")
    at = lambda x: F.col("y0") + (F.col("y1") - F.col("y0")) * ((x - F.col("x0")) / (F.col("x1") - F.col("x0")))
    column = F.pmod(F.col("_k"), F.lit(round(360 / width))).cast("int")
    return e.select(key, column.alias("column"), (F.col("_lo") - F.col("_turns")).alias("xa"), at(F.col("_lo")).alias("ya"), (F.col("_hi") - F.col("_turns")).alias("xb"), at(F.col("_hi")).alias("yb"), "sign")


def _reach(cut: DataFrame, key: str, row: float, low: str) -> DataFrame:
    """(key, column, row, low): rows of latitude that a shape can touch within a column, and its lowest latitude there."""
    span = cut.groupBy(key, "column").agg(F.min(F.least("ya", "yb")).alias(low), F.max(F.greatest("ya", "yb")).alias("_high"))
    return span.select(key, "column", low, F.explode(F.sequence(F.floor(F.col(low) / row).cast("int"), F.floor(F.col("_high") / row).cast("int"))).alias("row"))


def _common_strip() -> Column:
    """Integral of sin(latitude) over the strip from ``base`` up to the lower of two edges, over their common longitudes. The lower
    of both is even between the places where they cross each other and the base."""
    along = lambda t, p, q: F.col(p) + (F.col(q) - F.col(p)) * t
    cross = lambda d0, d1: F.when(d0 * d1 < 0, d0 / (d0 - d1)).otherwise(0.0)
    b = F.col("base")
    places = F.array_sort(F.array(F.lit(0.0), cross(F.col("e0") - F.col("f0"), F.col("e1") - F.col("f1")), cross(F.col("e0") - b, F.col("e1") - b), cross(F.col("f0") - b, F.col("f1") - b), F.lit(1.0)))
    height = lambda t: F.greatest(b, F.least(along(t, "e0", "e1"), along(t, "f0", "f1")))
    pieces = F.zip_with(F.slice(places, 1, 4), F.slice(places, 2, 4), lambda s, t: (t - s) * _mean_sine(height(s), height(t)))
    return F.radians(F.col("x1") - F.col("x0")) * (F.aggregate(pieces, F.lit(0.0), lambda s, v: s + v) - F.sin(F.radians(b)))


def overlaps(a: DataFrame, b: DataFrame, a_key: str, b_key: str, column: float = COLUMN, row: float = ROW) -> DataFrame:
    """(a_key, b_key, km2) of shapes that overlap by more than a square metre."""
    if 180 % column:
        raise ValueError("180 degrees must be a multiple of the column's width")
    e, f = _columns(a.withColumnRenamed(a_key, "_a"), "_a", column), _columns(b.withColumnRenamed(b_key, "_b"), "_b", column)
    met = _reach(e, "_a", row, "_la").join(_reach(f, "_b", row, "_lb"), ["column", "row"])
    met = met.select("_a", "_b", "column", F.greatest("_la", "_lb").alias("base")).distinct()
    e = e.select("_a", "column", F.col("xa").alias("ea"), F.col("xb").alias("eb"), F.col("ya").alias("ep"), F.col("yb").alias("eq"), F.col("sign").alias("es"))
    f = f.select("_b", "column", F.col("xa").alias("fa"), F.col("xb").alias("fb"), F.col("ya").alias("fp"), F.col("yb").alias("fq"), F.col("sign").alias("fs"))
    pairs = met.join(e, ["_a", "column"]).where("ep > base OR eq > base").join(f, ["_b", "column"]).where("fp > base OR fq > base")
    pairs = pairs.select("*", F.greatest("ea", "fa").alias("x0"), F.least("eb", "fb").alias("x1")).where("x0 < x1")
    at = lambda n, x: F.col(f"{n}p") + (F.col(f"{n}q") - F.col(f"{n}p")) * ((F.col(x) - F.col(f"{n}a")) / (F.col(f"{n}b") - F.col(f"{n}a")))
    strips = pairs.select("_a", "_b", "base", "x0", "x1", (F.col("es") * F.col("fs")).alias("sign"), *(at(n, f"x{k}").alias(f"{n}{k}") for n in "ef" for k in (0, 1)))
    strips = strips.select("_a", "_b", (F.col("sign") * _common_strip()).alias("_s"))
    return strips.groupBy(F.col("_a").alias(a_key), F.col("_b").alias(b_key)).agg((F.sum("_s") * EARTH_KM**2).alias("km2")).where(F.col("km2") > NOISE_KM2)


def overlap_weights(units: DataFrame, areas_: DataFrame, unit: str, area: str, least: float = 0.0, column: float = COLUMN, row: float = ROW) -> DataFrame:
    """area, unit, weight (share of the area), unit_fraction (share of the unit), overlap_km2 of units that overlap an area by at
    least ``least`` of it."""
    met = overlaps(units, areas_, unit, area, column, row)
    out = met.join(areas(areas_, area).withColumnRenamed("km2", "_a"), area).join(areas(units, unit).withColumnRenamed("km2", "_u"), unit)
    return out.select(area, unit, (F.col("km2") / F.col("_a")).alias("weight"), (F.col("km2") / F.col("_u")).alias("unit_fraction"), F.col("km2").alias("overlap_km2")).where(F.col("weight") >= least)


#: Fixed value: least share of a unit that a region must cover to be named beside its main one.
OTHER_SHARE = 0.10


def region_shares(units: DataFrame, regions: DataFrame, unit: str, region: str, **how: float) -> DataFrame:
    """unit, region, share (of the unit's area), place (by falling share, ties to the smaller region), named: a region other than
    the unit's ``own`` one and its largest that covers OTHER_SHARE or more. ``units`` has a column ``own``, which may be null.
    Shares need not add up to 1."""
    shares = overlap_weights(regions, units, region, unit, **how).select(unit, region, F.col("weight").alias("share"))
    # a unit has few regions, so its rows stand in one window
    row = F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(F.round("share", 12)), region))
    ranked = shares.withColumn("place", row).join(units.select(unit, "own"), unit)
    other = (F.col("place") > 1) & ~F.col("own").eqNullSafe(F.col(region)) & (F.round("share", 12) >= OTHER_SHARE)
    return ranked.select(unit, region, "share", "place", other.alias("named"))


def inside(x: Column, y: Column, shape: Column) -> Column:
    """Even-odd rule over all rings, each closed by its first point; points on a lower or left edge are inside."""
    crosses = lambda a, b: F.coalesce(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]), F.lit(False)).cast("int")
    of_ring = lambda r: F.aggregate(F.zip_with(r, following(r), crosses), F.lit(0), lambda s, v: s + v)
    return F.aggregate(F.transform(F.flatten(shape), of_ring), F.lit(0), lambda s, v: s + v) % 2 == 1


def centroids(df: DataFrame, key: str) -> DataFrame:
    """(key, x, y, square_degrees): planar centroid of shapes with an area, holes taken out."""
    turned = rings(df, key).select(key, "ring", (_turn(F.col("ring")) * F.when(F.col("hole"), -1.0).otherwise(1.0)).alias("_turn"))
    e = turned.select(key, "_turn", F.explode(F.arrays_zip(F.col("ring").alias("p"), following(F.col("ring")).alias("q"))).alias("_e"))
    px, py, qx, qy = (F.col(f"_e.{c}") for c in ("p.x", "p.y", "q.x", "q.y"))
    twice = F.col("_turn") * (px * qy - qx * py)
    sums = e.select(key, twice.alias("_a"), (twice * (px + qx) / 3).alias("_x"), (twice * (py + qy) / 3).alias("_y")).groupBy(key).agg(F.sum("_a").alias("_a"), F.sum("_x").alias("_x"), F.sum("_y").alias("_y"))
    return sums.where("_a > 0").select(key, (F.col("_x") / F.col("_a")).alias("x"), (F.col("_y") / F.col("_a")).alias("y"), (F.col("_a") / 2).alias("square_degrees"))


def point_on_surface(shape: Column) -> Column:
    """A point inside: the middle of the widest stretch within the shape along a line half-way between two neighbouring latitudes
    of its corners, those nearest to the middle of its box; null for a shape without one."""
    ys = F.array_sort(F.array_distinct(F.transform(F.flatten(F.flatten(shape)), lambda p: p["y"])))
    middle = lambda a: (F.array_min(a) + F.array_max(a)) / 2
    halves = lambda a: F.zip_with(F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - 1)), F.slice(a, F.lit(2), F.greatest(F.lit(0), F.size(a) - 1)), lambda u, v: (u + v) / 2)
    line = lambda a: F.array_min(F.transform(halves(a), lambda y: F.struct(F.abs(y - middle(a)).alias("d"), y.alias("y"))))["y"]

    def crossings(y: Column) -> Column:
        at = lambda a, b: F.when((a["y"] > y) != (b["y"] > y), a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]))
        xs = F.flatten(F.transform(F.flatten(shape), lambda r: F.zip_with(r, following(r), at)))
        return F.array_sort(F.filter(xs, lambda x: x.isNotNull()))

    def widest(y: Column, xs: Column) -> Column:
        spans = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(xs) - 1)), lambda i: (i % 2 == 1) & (i < F.size(xs))), lambda i: F.struct((F.element_at(xs, i + 1) - F.element_at(xs, i)).alias("w"), ((F.element_at(xs, i + 1) + F.element_at(xs, i)) / 2).alias("x")))
        return F.struct(F.array_max(spans)["x"].alias("x"), y.alias("y"))

    once = lambda value, f: F.transform(F.array(value), f)[0]
    return once(ys, lambda a: once(line(a), lambda y: once(crossings(y), lambda xs: widest(y, xs))))


@F.pandas_udf(T.ArrayType(T.StructType().add("x", T.DoubleType()).add("y", T.DoubleType())))
def simplified(ring: pd.Series, tolerance: pd.Series) -> pd.Series:
    """The line or closed ring with the points that lie farther than ``tolerance`` (degrees) from the line between those kept on
    either side, the first and last among them; a ring keeps its starting point."""

    def kept(points: list | None, limit: float) -> list | None:
        if points is None or len(points) < 3:
            return points
        v = np.array([(p["x"], p["y"]) for p in points], float)
        keep, todo = np.zeros(len(v), bool), [(0, len(v) - 1)]
        keep[[0, -1]] = True
        while todo:
            i, j = todo.pop()
            if j - i < 2:
                continue
            d, w = v[j] - v[i], v[i + 1 : j] - v[i]
            size = np.hypot(*d)
            t = np.clip((w @ d) / size**2, 0, 1)[:, None] if size else np.zeros((len(w), 1))
            far = np.hypot(*(w - t * d).T)
            k = int(far.argmax())
            if far[k] > limit:
                keep[i + 1 + k] = True
                todo += [(i, i + 1 + k), (i + 1 + k, j)]
        return [{"x": float(x), "y": float(y)} for x, y in v[keep]]

    return pd.Series([kept(p, t) for p, t in zip(ring, tolerance, strict=True)])
