"""Points and polygons without a geometry library; sizes and overlaps of polygons are in ``shapes``, outlines in ``outlines``.

Polygons are rows (polygon, ring or shape) in degrees. A join with points first meets on the cells of a grid that a polygon's box
touches, an equi-join; the exact test runs on the pairs that are left. Small boxes make few cells, and the cell size is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.scalars import EARTH_KM, haversine_km
from terrane.operators import shapes
from terrane.session import stored

KM_PER_DEGREE, HALF_GIRTH_KM = EARTH_KM * np.pi / 180, EARTH_KM * np.pi + 1


def box(shape: Column) -> dict[str, Column]:
    points = F.flatten(F.flatten(shape))
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"west": F.array_min(x), "east": F.array_max(x), "south": F.array_min(y), "north": F.array_max(y)}


def _cells(df: DataFrame, cell: float, west: Column, south: Column, east: Column, north: Column) -> DataFrame:
    lo = lambda c: F.floor(c / cell).cast("int")
    return df.withColumn("_cx", F.explode(F.sequence(lo(west), lo(east)))).withColumn("_cy", F.explode(F.sequence(lo(south), lo(north))))


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, polygon: str, cell: float = 5.0) -> DataFrame:
    """All pairs of a point row and a polygon (ring or shape) that covers it: the points' columns and polygon."""
    known = shapes.with_shape(polygons).select(polygon, F.col("shape").alias("_shape"))
    b = box(F.col("_shape"))
    gridded = _cells(known, cell, b["west"], b["south"], b["east"], b["north"])
    at = points.withColumn("_cx", F.floor(F.col(x) / cell).cast("int")).withColumn("_cy", F.floor(F.col(y) / cell).cast("int"))
    return at.join(gridded, ["_cx", "_cy"]).where(shapes.inside(F.col(x), F.col(y), F.col("_shape"))).select(*points.columns, polygon)


def smallest_cover(points: DataFrame, polygons: DataFrame, x: str, y: str, point: str, polygon: str, cell: float = 5.0) -> DataFrame:
    """Each point's smallest covering polygon in square degrees, ties to the smaller id: point, polygon."""
    sized = shapes.with_shape(polygons).select(polygon, shapes.square_degrees(F.col("shape")).alias("_area"))
    hits = points_in_polygons(points, polygons, x, y, polygon, cell=cell).join(sized, polygon)
    return hits.groupBy(point).agg(F.min_by(polygon, F.struct("_area", polygon)).alias(polygon))


def circle(lat: Column, lon: Column, radius_km: Column, corners: int = 64) -> Column:
    """Ring of points at a great-circle distance from a centre, counter-clockwise; convex away from poles and date line."""
    d, p, t = radius_km / EARTH_KM, F.radians(lat), F.radians(lon)

    def corner(k: Column) -> Column:
        bearing = -2 * np.pi * k / corners
        la = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(bearing))
        lo = t + F.atan2(F.sin(bearing) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(la))
        return F.struct(F.degrees(lo).alias("x"), F.degrees(la).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), corner)


def shared_edges(polygons: DataFrame, polygon: str, places: int = 6) -> DataFrame:
    """(i, j, n_edges) for polygons that share whole edges, both ways: an equi-join on edges with rounded ends."""
    ring = F.transform("ring", lambda q: F.struct(F.round(q["x"], places).alias("x"), F.round(q["y"], places).alias("y")))
    r = polygons.select(polygon, ring.alias("r"))
    nxt = F.concat(F.slice("r", F.lit(2), F.size("r") - 1), F.slice("r", F.lit(1), F.lit(1)))
    edges = r.select(polygon, F.explode(F.zip_with("r", nxt, lambda a, b: F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")))).alias("e"))
    a, b = (edges.select(F.col(polygon).alias(c), "e") for c in "ij")
    return a.join(b, "e").where("i <> j").groupBy("i", "j").agg(F.count("*").alias("n_edges"))


def meet(queries: DataFrame, points: DataFrame, reach_km: float) -> DataFrame:
    """Pairs of rows with columns lat and lon that can be at most ``reach_km`` apart, as structs ``q`` and ``p``; all pairs that are
    so near are among them.

    Points lie in cells about ``reach_km`` high; a query is dealt to the cells that its reach touches, wider in longitude towards
    the poles and around the date line, and meets their points by an equi-join.
    """
    step = max(0.01, reach_km / KM_PER_DEGREE)
    across = max(1, int(360 / step))
    width = 360.0 / across
    cell_y = lambda lat: F.floor((lat + 90) / step).cast("int")
    turn = lambda lon: F.pmod(lon + 180, F.lit(360.0))
    reach = reach_km / KM_PER_DEGREE * 1.0001
    top = F.abs(F.col("lat")) + reach
    # beyond the pole, or where a turn of longitude is within reach, all cells of the row
    sine = F.sin(F.lit(float(np.radians(min(reach, 90.0))))) / F.cos(F.radians("lat"))
    half = F.when((top >= 90) | (sine >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), sine))) * 1.0001)
    rows = F.sequence(F.greatest(F.lit(0), cell_y(F.col("lat") - reach)), cell_y(F.least(F.lit(90.0), F.col("lat") + reach)))
    columns = F.when(half * 2 + width >= 360, F.sequence(F.lit(0), F.lit(across - 1))).otherwise(F.transform(F.sequence(F.floor((turn(F.col("lon")) - half) / width), F.floor((turn(F.col("lon")) + half) / width)), lambda c: F.pmod(c, F.lit(across)).cast("int")))
    q = queries.select(F.struct(*queries.columns).alias("q"), F.explode(rows).alias("_cy"), columns.alias("_c"))
    q = q.select("q", "_cy", F.explode(F.array_distinct("_c")).alias("_cx"))
    p = points.select(F.struct(*points.columns).alias("p"), cell_y(F.col("lat")).alias("_cy"), F.least(F.lit(across - 1), F.floor(turn(F.col("lon")) / width)).cast("int").alias("_cx"))
    return q.join(p, ["_cx", "_cy"]).select("q", "p")


def _spots(df: DataFrame, name: str) -> DataFrame:
    """(name, lat, lon): the distinct places, each named by itself."""
    return df.select("lat", "lon").distinct().withColumn(name, F.struct("lat", "lon"))


def within_km(queries: DataFrame, points: DataFrame, query: str, point: str, km: float) -> DataFrame:
    """(query, point, km): all pairs of rows with columns lat and lon that are at most ``km`` apart. Distances are found between
    distinct places, whose rows are put in afterwards, dealt by the points' places to all tasks, as few rows of input make many."""
    near = stored(_near(_spots(queries, "_q"), _spots(points, "_p"), "_q", "_p", km))
    parts = max(4, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = queries.select(query, F.struct("lat", "lon").alias("_q"))
    at = points.select(point, F.struct("lat", "lon").alias("_p")).repartition(parts, "_p")
    reached = asked.join(near.hint("merge"), "_q").select(query, "_p", "km").repartition(parts, "_p")
    return reached.join(at.hint("merge"), "_p").select(query, point, "km")


def _near(queries: DataFrame, points: DataFrame, query: str, point: str, km: float) -> DataFrame:
    """``within_km`` row by row."""
    far = haversine_km(F.col("q.lat"), F.col("q.lon"), F.col("p.lat"), F.col("p.lon"))
    met = meet(queries.select(query, "lat", "lon"), points.select(point, "lat", "lon"), km)
    return met.select(F.col(f"q.{query}").alias(query), F.col(f"p.{point}").alias(point), far.alias("km")).where(F.col("km") <= km)


def widening(left: DataFrame, query: str, measure: Callable[[DataFrame, float], DataFrame], start: float, limit: float, by: str = "km") -> DataFrame:
    """Rows of ``measure(left, reach)``, which are at most one for each query and hold what is nearest to it among all that lies
    within reach: a query whose nearest is ``by`` at most the reach is done, the others try twice the reach, up to ``limit``."""
    left, reach, done = stored(left), min(start, limit), None
    while True:
        found = stored(measure(left, reach).where(F.col(by) <= reach))
        done = found if done is None else done.unionByName(found)
        if reach >= limit:
            return done
        left = stored(left.join(found.select(query).distinct(), query, "left_anti"))
        if left.isEmpty():
            return done
        reach = min(2 * reach, limit)


def nearest_points(queries: DataFrame, points: DataFrame, query: str, point: str, k: int = 1, start_km: float = 200.0, most_km: float | None = None) -> DataFrame:
    """(query, point, km, place): each query's ``k`` nearest points, ties to the smaller id; with ``most_km``, none farther.

    Rings are widened: a query that has ``k`` points within a reach is done, since all nearer ones are among them; the others
    try twice the reach, up to half the earth's girth. Queries at one place are asked once, and of points at one place only the
    ``k`` smallest ids can be among the nearest, so crowds of either cost no pairs.
    """
    asked = queries.select(query, F.struct("lat", "lon").alias("_q"))
    crowd = Window.partitionBy("lat", "lon").orderBy(point)
    few = points.select(point, "lat", "lon").withColumn("_n", F.row_number().over(crowd)).where(F.col("_n") <= k).drop("_n")
    found = _nearest(_spots(queries, "_q"), stored(few), point, k, start_km, most_km)
    return asked.join(found.hint("shuffle_hash"), "_q").select(query, point, "km", "place")


def _nearest(queries: DataFrame, points: DataFrame, point: str, k: int, start_km: float, most_km: float | None) -> DataFrame:
    query = "_q"
    limit = min(most_km or HALF_GIRTH_KM, HALF_GIRTH_KM)
    left, reach, done = stored(queries.select(query, "lat", "lon")), min(start_km, limit), None
    order = Window.partitionBy(query).orderBy(F.round("km", 9), point)
    while True:
        found = _near(left, points, query, point, reach).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        last = reach >= limit
        found = stored(found)
        full = found.where(F.col("place") == k).select(query)
        part = found if last else found.join(full, query, "left_semi")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        left = stored(left.join(full, query, "left_anti"))
        if not left.limit(1).count():
            return done
        reach = min(2 * reach, limit)
