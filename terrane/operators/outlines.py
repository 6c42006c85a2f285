"""Outlines: lengths, distances from points and from other outlines, borders that two polygons share.

For distances an edge is the arc of the great circle between its ends. Arcs are cut into pieces of bounded length, and a piece
lies in the grid cell of its middle. A query meets the pieces whose middle is within its reach and half a piece more, an
equi-join on cells that knows poles and the date line, and is measured against the arcs that are left. A query with no outline
within its reach tries twice the reach; one that has some is done, as all nearer ones are among them.

Shared borders are found between edges as they are drawn, straight in degrees.

Defined cases: null shapes and rings of fewer than three points have no outline; repeated points make no edge; ends of an edge are not
opposite points of the globe; equal distances, to a millimetre, go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalars import EARTH_KM, haversine_km
from terrane.operators import geometry, shapes
from terrane.session import stored

#: Longest piece of an arc.
PIECE_KM = 50.0


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` computed once: without it, each use would repeat the whole expression."""
    return F.transform(F.array(value), f)[0]


def _cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _mix(a: Column, s: Column, b: Column, t: Column) -> Column:
    return F.struct(*((a[c] * s + b[c] * t).alias(c) for c in "xyz"))


def vector(lat: Column, lon: Column) -> Column:
    p, t = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(p) * F.cos(t)).alias("x"), (F.cos(p) * F.sin(t)).alias("y"), F.sin(p).alias("z"))


def _place(v: Column) -> Column:
    return F.struct(F.degrees(F.atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))).alias("lat"), F.degrees(F.atan2(v["y"], v["x"])).alias("lon"))


def _edges(df: DataFrame, key: str) -> DataFrame:
    """(key, a, b): ends of each edge of each ring, in degrees; of an open line if ``df`` has a column ``path``, an array of points."""
    if "path" in df.columns:
        n = F.greatest(F.lit(0), F.size("path") - 1)
        some = df.where("path IS NOT NULL").select(key, F.explode(F.arrays_zip(F.slice("path", F.lit(1), n).alias("a"), F.slice("path", F.lit(2), n).alias("b"))).alias("_e"))
        return some.select(key, F.col("_e.a").alias("a"), F.col("_e.b").alias("b")).where("a.x <> b.x OR a.y <> b.y")
    pairs = shapes.rings(df, key).select(key, F.explode(F.arrays_zip(F.col("ring").alias("a"), shapes.following(F.col("ring")).alias("b"))).alias("_e"))
    return pairs.select(key, F.col("_e.a").alias("a"), F.col("_e.b").alias("b")).where("a.x <> b.x OR a.y <> b.y")


def lengths(df: DataFrame, key: str) -> DataFrame:
    """(key, km) of all rings, holes among them."""
    return _edges(df, key).groupBy(key).agg(F.sum(haversine_km(F.col("a.y"), F.col("a.x"), F.col("b.y"), F.col("b.x"))).alias("km"))


def pieces(df: DataFrame, key: str, piece_km: float = PIECE_KM) -> DataFrame:
    """(key, a, b, lat, lon, half_km): the outline's arcs in pieces of equal length up to ``piece_km``, with ends as vectors, and
    each piece's middle and half its length."""
    arcs = _edges(df, key).select(key, vector(F.col("a.y"), F.col("a.x")).alias("_a"), vector(F.col("b.y"), F.col("b.x")).alias("_b"), (haversine_km(F.col("a.y"), F.col("a.x"), F.col("b.y"), F.col("b.x")) / EARTH_KM).alias("_w"))
    arcs = arcs.where("_w > 0").withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_w") * EARTH_KM / piece_km)).cast("int"))
    at = lambda t: _mix(F.col("_a"), F.sin(F.col("_w") * (1 - t)) / F.sin("_w"), F.col("_b"), F.sin(F.col("_w") * t) / F.sin("_w"))
    cut = arcs.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    # ends that two pieces share come from the same sum, and an edge's own ends stay as they are
    end = lambda k: F.when(k == 0, F.col("_a")).when(k == F.col("_n"), F.col("_b")).otherwise(at(k / F.col("_n")))
    out = cut.select(key, end(F.col("_k")).alias("a"), end(F.col("_k") + 1).alias("b"), _let(at((F.col("_k") + 0.5) / F.col("_n")), _place).alias("_m"), (F.col("_w") * EARTH_KM / F.col("_n") / 2).alias("half_km"))
    return out.select(key, "a", "b", "_m.lat", "_m.lon", "half_km")


def _apart(p: Column, q: Column) -> Column:
    """Kilometres between two vectors, exact for near ones too."""
    return _let(F.struct(_cross(p, q).alias("c"), _dot(p, q).alias("d")), lambda v: F.atan2(F.sqrt(_dot(v["c"], v["c"])), v["d"]) * EARTH_KM)


def nearest_on_arc(p: Column, a: Column, b: Column) -> Column:
    """The vector on the arc from a to b that is nearest to p."""

    def of_foot(n: Column, foot: Column) -> Column:
        long = F.sqrt(_dot(foot, foot))
        between = (_dot(_cross(a, foot), n) >= 0) & (_dot(_cross(foot, b), n) >= 0) & (long > 0)
        return F.when(between, F.struct(*((foot[c] / long).alias(c) for c in "xyz"))).when(_dot(p, a) >= _dot(p, b), a).otherwise(b)

    # p without its part along n, times n squared
    return _let(_cross(a, b), lambda n: _let(_mix(p, _dot(n, n), n, -_dot(p, n)), lambda foot: of_foot(n, foot)))


def _arc_km(p: Column, a: Column, b: Column) -> Column:
    return _let(nearest_on_arc(p, a, b), lambda n: _apart(p, n))


def _arcs_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two arcs cross: the ends of each lie on both sides of the other's plane, and on the same half of the globe."""
    n, m = _cross(a, b), _cross(c, d)
    sides = F.struct(_dot(n, c).alias("s1"), _dot(n, d).alias("s2"), _dot(m, a).alias("t1"), _dot(m, b).alias("t2"))
    return _let(sides, lambda v: (v["s1"] * v["s2"] < 0) & (v["t1"] * v["t2"] < 0) & (v["s1"] * v["t1"] < 0))


def _limit(most_km: float | None) -> float:
    return min(most_km or geometry.HALF_GIRTH_KM, geometry.HALF_GIRTH_KM)


def _least(rows: DataFrame, query: str, key: str) -> DataFrame:
    best = F.min(F.struct(F.round("km", 6).alias("_by"), F.col(key), F.col("km"), F.col("lat"), F.col("lon")))
    return rows.groupBy(query).agg(best.alias("_b")).select(query, f"_b.{key}", "_b.km", "_b.lat", "_b.lon")


def nearest_outline(queries: DataFrame, polygons: DataFrame, query: str, key: str, own: str | None = None, start_km: float = 100.0, most_km: float | None = None, piece_km: float = PIECE_KM) -> DataFrame:
    """query, key, km, lat, lon of the nearest outline to each query (query, lat, lon), and its nearest place. With ``own``, a column
    of the queries, the polygon of that key is left out. Queries with none within ``most_km`` have no row."""
    parts = stored(pieces(polygons, key, piece_km))
    asked = queries.select(query, "lat", "lon", *([F.col(own).alias("_own")] if own else []))
    tasks = max(4, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def measure(left: DataFrame, reach: float) -> DataFrame:
        # a query is a short row that meets many arcs, so the rows' size must not decide on the number of tasks
        met = geometry.meet(left.repartition(tasks, query), parts, reach + piece_km / 2)
        met = met.where(~F.col("q._own").eqNullSafe(F.col(f"p.{key}"))) if own else met
        met = met.withColumn("_v", vector(F.col("q.lat"), F.col("q.lon")))
        met = met.withColumn("_n", nearest_on_arc(F.col("_v"), F.col("p.a"), F.col("p.b")))
        rows = met.select(F.col(f"q.{query}").alias(query), F.col(f"p.{key}").alias(key), _apart(F.col("_v"), F.col("_n")).alias("km"), _let(F.col("_n"), _place).alias("_at"))
        return _least(rows.select(query, key, "km", "_at.lat", "_at.lon"), query, key)

    return geometry.widening(asked, query, measure, start_km, _limit(most_km))


def nearest_polygon(queries: DataFrame, polygons: DataFrame, query: str, key: str, own: str | None = None, **how: float | None) -> DataFrame:
    """As ``nearest_outline``, but a polygon that covers the query is 0 km away, at the query itself."""
    q = queries.select(query, "lat", "lon", *([F.col(own).alias("_own")] if own else []))
    over = geometry.points_in_polygons(q, polygons, "lon", "lat", key)
    over = over.where(~F.col("_own").eqNullSafe(F.col(key))) if own else over
    over = stored(_least(over.select(query, key, F.lit(0.0).alias("km"), "lat", "lon"), query, key))
    rest = q.join(over.select(query), query, "left_anti")
    return over.unionByName(nearest_outline(rest, polygons, query, key, "_own" if own else None, **how))


def outline_gaps(polygons: DataFrame, coast: DataFrame, polygon: str, key: str, start_km: float = 100.0, most_km: float | None = None, piece_km: float = PIECE_KM) -> DataFrame:
    """polygon, key, km: the least distance between each polygon's outline and the nearest of ``coast``; 0 where they cross."""
    mine, parts = stored(pieces(polygons, polygon, piece_km)), stored(pieces(coast, key, piece_km))

    def measure(left: DataFrame, reach: float) -> DataFrame:
        met = geometry.meet(mine.join(left, polygon, "left_semi"), parts, reach + piece_km)
        a, b, c, d = (F.col(x) for x in ("q.a", "q.b", "p.a", "p.b"))
        ends = [_arc_km(v, x, y) for v, x, y in ((a, c, d), (b, c, d), (c, a, b), (d, a, b))]
        met = met.select(F.col(f"q.{polygon}").alias(polygon), F.col(f"p.{key}").alias(key), _arcs_meet(a, b, c, d).alias("_meet"), F.array_min(F.array(*ends)).alias("_ends"))
        km = F.when(F.col("_meet"), 0.0).otherwise(F.col("_ends"))
        none = F.lit(None).cast("double")
        return _least(met.select(polygon, key, km.alias("km"), none.alias("lat"), none.alias("lon")), polygon, key).drop("lat", "lon")

    return geometry.widening(mine.select(polygon).distinct(), polygon, measure, start_km, _limit(most_km))


def coast_distances(places: DataFrame, units: DataFrame, coast: DataFrame, place: str, unit: str, key: str, near_km: float) -> DataFrame:
    """place, outline_km (from its unit's outline to the nearest coast) and edge_km (from the spot of that outline nearest to the
    place to the coast), null beyond ``near_km``; ``places`` is (place, unit, lat, lon). Places of a unit at one point are asked once."""
    gaps = outline_gaps(units, coast, unit, key, most_km=near_km).select(unit, F.col("km").alias("outline_km"))
    point = F.struct(unit, "lat", "lon").alias("_point")
    own = places.select(point, F.col(unit).alias("_unit"), "lat", "lon").distinct()
    parts = pieces(units, unit)
    met = own.join(parts.select(F.col(unit).alias("_unit"), "a", "b"), "_unit").withColumn("_v", vector(F.col("lat"), F.col("lon")))
    met = met.withColumn("_n", nearest_on_arc(F.col("_v"), F.col("a"), F.col("b")))
    spot = met.groupBy("_point").agg(F.min_by("_n", F.struct(F.round(_apart(F.col("_v"), F.col("_n")), 9), F.col("_n.x"), F.col("_n.y"), F.col("_n.z"))).alias("_n"))
    spot = spot.select("_point", _let(F.col("_n"), _place).alias("_at")).select("_point", "_at.lat", "_at.lon")
    edge = nearest_outline(spot, coast, "_point", key, most_km=near_km).select("_point", F.col("km").alias("edge_km"))
    return places.select(place, unit, point).join(gaps, unit, "left").join(edge, "_point", "left").select(place, unit, "outline_km", "edge_km")


def touching(polygons: DataFrame, key: str, cell: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    """(i, j, shared_km, mid_lat, mid_lon) for polygons whose outlines touch, both ways.

    Parts of edges that lie on each other within ``tolerance`` degrees count as shared, whether or not the edges have the same
    ends; the middle is theirs, weighted by length in degrees. Polygons that meet in points only share 0 km, and the middle is
    that of the points. Edges meet on the cells that they pass; a part is measured in the cell of its middle. Edges along the
    date line are taken at -180.
    """
    seam = lambda e: (F.abs(F.col(f"{e}.x") - 180) <= tolerance)
    e = _edges(polygons, key).withColumn("_seam", seam("a") & seam("b"))
    move = lambda c: F.struct((F.col(f"{c}.x") - F.when(F.col("_seam"), 360.0).otherwise(0.0)).alias("x"), F.col(f"{c}.y").alias("y"))
    e = e.select(F.col(key).alias("k"), move("a").alias("a"), move("b").alias("b"))
    lo = lambda c: F.floor((F.least(F.col(f"a.{c}"), F.col(f"b.{c}")) - tolerance) / cell).cast("int")
    hi = lambda c: F.floor((F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) + tolerance) / cell).cast("int")
    e = e.select("k", "a", "b", F.explode(F.sequence(lo("x"), hi("x"))).alias("cx"), F.sequence(lo("y"), hi("y")).alias("_cy")).withColumn("cy", F.explode("_cy")).drop("_cy")
    # a slanted edge leaves most cells of its box untouched
    rise = lambda x, y: (F.col("b.x") - F.col("a.x")) * (y * cell - F.col("a.y")) - (F.col("b.y") - F.col("a.y")) * (x * cell - F.col("a.x"))
    sides = [rise(F.col("cx") + i, F.col("cy") + j) for i in (0, 1) for j in (0, 1)]
    slack = tolerance * (F.abs(F.col("b.x") - F.col("a.x")) + F.abs(F.col("b.y") - F.col("a.y")))
    e = e.where((F.least(*sides) <= slack) & (F.greatest(*sides) >= -slack))
    side = lambda n: e.select(*(F.col(c).alias(c if c in ("cx", "cy") else f"{n}_{c}") for c in e.columns))
    pair = side("i").join(side("j"), ["cx", "cy"]).where("i_k <> j_k")
    # i's edge from p along d; j's ends at t along it and h beside it
    dx, dy = F.col("i_b.x") - F.col("i_a.x"), F.col("i_b.y") - F.col("i_a.y")
    square = dx * dx + dy * dy
    along = lambda q: (dx * (F.col(f"{q}.x") - F.col("i_a.x")) + dy * (F.col(f"{q}.y") - F.col("i_a.y"))) / square
    beside = lambda q: F.abs(dx * (F.col(f"{q}.y") - F.col("i_a.y")) - dy * (F.col(f"{q}.x") - F.col("i_a.x"))) / F.sqrt(square)
    pair = pair.select("*", square.alias("_s"), along("j_a").alias("_t0"), along("j_b").alias("_t1"), beside("j_a").alias("_h0"), beside("j_b").alias("_h1"))
    slack = F.lit(tolerance) / F.sqrt("_s")
    on = lambda k: (F.col(f"_h{k}") <= tolerance) & F.col(f"_t{k}").between(-slack, 1 + slack)
    lined = (F.col("_h0") <= tolerance) & (F.col("_h1") <= tolerance)
    begin, end = F.greatest(F.lit(0.0), F.least("_t0", "_t1")), F.least(F.lit(1.0), F.greatest("_t0", "_t1"))
    at = lambda t: F.struct((F.col("i_a.x") + (F.col("i_b.x") - F.col("i_a.x")) * t).alias("x"), (F.col("i_a.y") + (F.col("i_b.y") - F.col("i_a.y")) * t).alias("y"))
    line = F.when(lined & (end - begin > slack), F.struct(at(begin).alias("p"), at(end).alias("q")))
    # a contact in a point: an end of j's edge on i's; the other way round is found with i and j exchanged
    point = F.when(F.col("line").isNull(), F.when(on(0), F.col("j_a")).when(on(1), F.col("j_b")))
    found = pair.select(F.col("i_k").alias("i"), F.col("j_k").alias("j"), "cx", "cy", "j_a", "j_b", "_s", "_t0", "_t1", "_h0", "_h1", line.alias("line")).withColumn("point", point)
    # the cell that holds the middle of the shared part counts it; both edges pass through that one
    home = lambda c: F.floor((F.col(f"line.p.{c}") + F.col(f"line.q.{c}")) / 2 / cell) == F.col(f"c{c}")
    found = found.where("line IS NOT NULL OR point IS NOT NULL").where(F.col("line").isNull() | (home("x") & home("y")))
    p, q = F.col("line.p"), F.col("line.q")
    size = F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2))
    grid = lambda c: F.round(F.col(f"point.{c}"), 8)
    lines = found.where("line IS NOT NULL").select("i", "j", haversine_km(p["y"], p["x"], q["y"], q["x"]).alias("km"), size.alias("w"), (size * (p["y"] + q["y"]) / 2).alias("y"), (size * (p["x"] + q["x"]) / 2).alias("x"))
    lines = lines.groupBy("i", "j").agg(F.sum("km").alias("shared_km"), (F.sum("y") / F.sum("w")).alias("mid_lat"), (F.sum("x") / F.sum("w")).alias("mid_lon"))
    dots = found.where("line IS NULL").select("i", "j", grid("y").alias("y"), grid("x").alias("x"))
    dots = dots.unionByName(dots.select(F.col("j").alias("i"), F.col("i").alias("j"), "y", "x")).distinct()
    dots = dots.groupBy("i", "j").agg(F.avg("y").alias("_y"), F.avg("x").alias("_x"))
    both = lines.join(dots, ["i", "j"], "full")
    return both.select("i", "j", F.coalesce("shared_km", F.lit(0.0)).alias("shared_km"), F.coalesce("mid_lat", "_y").alias("mid_lat"), F.coalesce("mid_lon", "_x").alias("mid_lon"))


def length_inside(lines: DataFrame, polygons: DataFrame, line: str, polygon: str, cell: float = 5.0) -> DataFrame:
    """(line, polygon, km) of lines (path) that run inside polygons, edges taken straight in degrees.

    An edge and a polygon meet once, on the cells that their boxes touch; the edge is cut where it crosses the outline, and the
    parts whose middle lies inside count.
    """
    e = _edges(lines, line).withColumn("_no", F.monotonically_increasing_id())
    e = stored(e)  # numbered once
    low, high = (lambda c: F.floor(F.least(F.col(f"a.{c}"), F.col(f"b.{c}")) / cell).cast("int")), (lambda c: F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / cell).cast("int"))
    at = e.select("_no", F.explode(F.sequence(low("x"), high("x"))).alias("_cx"), F.sequence(low("y"), high("y")).alias("_c")).select("_no", "_cx", F.explode("_c").alias("_cy"))
    known = shapes.with_shape(polygons).select(polygon, F.col("shape").alias("_shape"))
    b = geometry.box(F.col("_shape"))
    lo = lambda c: F.floor(c / cell).cast("int")
    cells = known.select(polygon, F.explode(F.sequence(lo(b["west"]), lo(b["east"]))).alias("_cx"), F.sequence(lo(b["south"]), lo(b["north"])).alias("_c")).select(polygon, "_cx", F.explode("_c").alias("_cy"))
    met = at.join(cells, ["_cx", "_cy"]).select("_no", polygon).distinct().join(e, "_no").join(known, polygon)
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")

    def crossing(p: Column, q: Column) -> Column:
        """Where along the edge (0 to 1) it meets the outline's edge from p to q; null if it doesn't."""
        ex, ey = q["x"] - p["x"], q["y"] - p["y"]
        whole = dx * ey - dy * ex
        t = F.try_divide((p["x"] - F.col("a.x")) * ey - (p["y"] - F.col("a.y")) * ex, whole)
        s = F.try_divide((p["x"] - F.col("a.x")) * dy - (p["y"] - F.col("a.y")) * dx, whole)
        return F.when(s.between(0, 1) & (t > 0) & (t < 1), t)

    cuts = F.filter(F.flatten(F.transform(F.flatten("_shape"), lambda r: F.zip_with(r, shapes.following(r), crossing))), lambda t: t.isNotNull())
    met = met.withColumn("_t", F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts)))
    parts = met.select(line, polygon, "a", "b", "_shape", F.explode(F.arrays_zip(F.slice("_t", F.lit(1), F.size("_t") - 1).alias("s"), F.slice("_t", F.lit(2), F.size("_t") - 1).alias("t"))).alias("_p")).where("_p.t > _p.s")
    x, y = (lambda t: F.col("a.x") + (F.col("b.x") - F.col("a.x")) * t), (lambda t: F.col("a.y") + (F.col("b.y") - F.col("a.y")) * t)
    middle = (F.col("_p.s") + F.col("_p.t")) / 2
    inside = parts.where(shapes.inside(x(middle), y(middle), F.col("_shape")))
    s, t = F.col("_p.s"), F.col("_p.t")
    return inside.groupBy(line, polygon).agg(F.sum(haversine_km(y(s), x(s), y(t), x(t))).alias("km"))


#: Least kilometres of a river inside a unit, classes by which a much larger river is ahead, and how far it may be.
OWN_KM, STEP, LARGER_KM = 1.0, 2, 25.0


def rivers_near(places: DataFrame, units: DataFrame, rivers: DataFrame, place: str, unit: str, river: str, least_class: int, step: int = STEP, larger_km: float = LARGER_KM, start_km: float = 100.0) -> DataFrame:
    """place, own_class (least class of a river with more than OWN_KM inside the place's unit), river, class, km (the nearest of class
    ``least_class`` or below), larger, larger_class, larger_km (the nearest that is ``step`` classes below own_class, within
    ``larger_km``). Classes count down with size. ``places`` is (place, unit, lat, lon), ``rivers`` (river, class, path); each
    class that is asked for is one search, and classes are few.
    """
    inside = length_inside(rivers, units, river, unit).where(F.col("km") > OWN_KM).join(rivers.select(river, "class"), river)
    own = inside.groupBy(unit).agg(F.min("class").alias("own_class"))
    asked = stored(places.join(own, unit, "left").select(place, "lat", "lon", "own_class"))
    named = rivers.select(river, "class")
    near = nearest_outline(asked, rivers.where(F.col("class") <= least_class), place, river, start_km=start_km).join(named, river).select(place, river, "class", "km")
    larger = None
    for own_class in sorted(r[0] for r in asked.where("own_class IS NOT NULL").select("own_class").distinct().collect()):
        of = nearest_outline(asked.where(F.col("own_class") == own_class), rivers.where(F.col("class") <= own_class - step), place, river, start_km=larger_km, most_km=larger_km)  # one search, as the reach is short
        larger = of if larger is None else larger.unionByName(of)
    out = asked.select(place, "own_class").join(near, place, "left")
    if larger is None:
        return out.select("*", F.lit(None).cast(dict(rivers.dtypes)[river]).alias("larger"), F.lit(None).cast("int").alias("larger_class"), F.lit(None).cast("double").alias("larger_km"))
    larger = larger.join(named, river).select(place, F.col(river).alias("larger"), F.col("class").alias("larger_class"), F.col("km").alias("larger_km"))
    return out.join(larger, place, "left")
