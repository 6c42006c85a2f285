"""Regions and points: shares, nearest other region, distances of outlines, entry points, point signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import blocks, entry, geometry, outlines, point, position, shapes, statements
from terrane.plans import signature as sig
from terrane.plans.curves import PLACED, placed
from terrane.plans.entry import ASKED, BRICKS, _asked, bricks
from terrane.plans.registry import Tables, query, rounded
from terrane.plans.spatial import AREA, BOX, _areas, _boxes, _sides, box_of, corner


@query("R13_region_shares", f"""WITH {AREA}, p AS (SELECT unit, area AS region, o / ub.z AS share FROM ov JOIN ub USING (unit)),
r AS (SELECT *, (row_number() OVER (PARTITION BY unit ORDER BY round(share, 12) DESC, region))::INTEGER AS place FROM p)
SELECT unit, region, round(share, 6) AS share, place, place > 1 AND region <> (unit + 1) % 25 AND round(share, 12) >= 0.1 AS named FROM r""")
def r13s(t: Tables) -> DataFrame:
    units = _boxes(t).select(F.col("polygon").alias("unit"), "ring", ((F.col("polygon") + 1) % 25).alias("own"))
    return rounded(shapes.region_shares(units, _areas(t).withColumnRenamed("area", "region"), "unit", "region"))


#: Corners of the areas' rings in order, and their edges between vectors a and e.
ARCS = """rg AS (SELECT polygon AS area, unnest(CASE polygon % 3 WHEN 0 THEN [[[w, s], [w + 40, s], [w + 40, s + (35 + h) / 2.0], [w + 20, s + (35 + h) / 2.0], [w + 20, s + 35 + h], [w, s + 35 + h]]]
WHEN 1 THEN [[[w, s], [w + 40, s], [w + 40, s + 35 + h], [w, s + 35 + h]], [[w + 10, s + 10], [w + 30, s + 10], [w + 30, s + 20], [w + 10, s + 20]]]
ELSE [[[w, s], [w + 15, s], [w + 15, s + 35 + h], [w, s + 35 + h]], [[w + 25, s], [w + 40, s], [w + 40, s + 35 + h], [w + 25, s + 35 + h]]] END) AS r FROM b),
sg AS (SELECT area, r[i] AS p, r[i % len(r) + 1] AS q FROM (SELECT area, r, unnest(range(1, len(r) + 1)) AS i FROM rg))"""


def _vector(lat: str, lon: str, v: str) -> str:
    return f"cos(radians({lat})) * cos(radians({lon})) AS {v}x, cos(radians({lat})) * sin(radians({lon})) AS {v}y, sin(radians({lat})) AS {v}z"


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{c} * {b}{c}" for c in "xyz") + ")"


def _cross(a: str, b: str, out: str) -> str:
    return ", ".join(f"{a}{c} * {b}{d} - {a}{d} * {b}{c} AS {out}{e}" for c, d, e in ("yzx", "zxy", "xyz"))


def _arc_sql(rows: str) -> str:
    """``rows`` (p, a and e as x, y, z) with km from p to the arc from a to e, and the vector m on it that is nearest."""
    normal = f"SELECT *, {_cross('a', 'e', 'n')} FROM ({rows})"
    foot = f"SELECT *, {', '.join(f'p{c} * {_dot("n", "n")} - n{c} * {_dot("p", "n")} AS f{c}' for c in 'xyz')} FROM ({normal})"
    sides = f"SELECT *, {_cross('a', 'f', 'g')}, {_cross('f', 'e', 'h')} FROM ({foot})"
    between = f"({_dot('g', 'n')} >= 0 AND {_dot('h', 'n')} >= 0 AND {_dot('f', 'f')} > 0)"
    near = ", ".join(f"CASE WHEN {between} THEN f{c} / sqrt({_dot('f', 'f')}) WHEN {_dot('p', 'a')} >= {_dot('p', 'e')} THEN a{c} ELSE e{c} END AS m{c}" for c in "xyz")
    apart = f"SELECT *, {_cross('p', 'm', 'k')} FROM (SELECT *, {near} FROM ({sides}))"
    return f"SELECT *, 6371.0088 * atan2(sqrt({_dot('k', 'k')}), {_dot('p', 'm')}) AS km FROM ({apart})"


VECTORS = f"sv AS (SELECT area, {_vector('p[2]', 'p[1]', 'a')}, {_vector('q[2]', 'q[1]', 'e')} FROM sg)"


@query("R13_next_region", f"""WITH {BOX}, {ARCS}, {VECTORS}, {ASKED}, qv AS (SELECT query_id, lat, lon, query_id % 25 AS own, {_vector('lat', 'lon', 'p')} FROM q),
d AS (SELECT query_id, area, km FROM ({_arc_sql('SELECT qv.*, sv.* FROM qv JOIN sv ON area <> own')})
UNION ALL SELECT query_id, polygon, 0 FROM qv JOIN b ON polygon <> own AND lon >= w AND lon < w + 40 AND lat >= s AND lat < s + 35 + h
AND CASE polygon % 3 WHEN 0 THEN NOT (lon >= w + 20 AND lat >= s + (35 + h) / 2.0) WHEN 1 THEN NOT (lon >= w + 10 AND lon < w + 30 AND lat >= s + 10 AND lat < s + 20) ELSE NOT (lon >= w + 15 AND lon < w + 25) END)
SELECT query_id, arg_min(area, [round(km, 6), area]) AS region, round(min(km), 4) AS km FROM d GROUP BY 1""")
def r13n(t: Tables) -> DataFrame:
    asked = _asked(t).withColumn("own", F.col("query_id") % 25)
    return rounded(outlines.nearest_polygon(asked, _areas(t).withColumnRenamed("area", "region"), "query_id", "region", own="own").select("query_id", "region", "km"), 4)


#: Small units within the boxes, whose outlines cross those of the areas here and there.
UNITS = "un AS (SELECT polygon AS unit, [[w + 2, s + 12], [w + 9, s + 12], [w + 9, s + 30], [w + 2, s + 30]] AS r FROM b), us AS (SELECT unit, r[i] AS p, r[i % 4 + 1] AS q FROM (SELECT unit, r, unnest(range(1, 5)) AS i FROM un))"


def _units(t: Tables) -> DataFrame:
    nation, w, s, _, _ = _sides(t)
    return nation.select(F.col("n_nationkey").alias("unit"), box_of(w + 2, s + 12, w + 9, s + 30).alias("ring"))


_MEET = f"SELECT *, {_cross('a', 'e', 'n')}, {_cross('c', 'd', 'm')} FROM uv, (SELECT area, ax AS cx, ay AS cy, az AS cz, ex AS dx, ey AS dy, ez AS dz FROM sv)"


@query("R14_coast_distances", f"""WITH {BOX}, {ARCS}, {VECTORS}, {UNITS}, uv AS (SELECT unit, {_vector('p[2]', 'p[1]', 'a')}, {_vector('q[2]', 'q[1]', 'e')} FROM us),
gap AS (SELECT unit, km FROM ({_arc_sql('SELECT unit, uv.ax AS px, uv.ay AS py, uv.az AS pz, sv.* FROM uv, sv')}) UNION ALL SELECT unit, km FROM ({_arc_sql('SELECT sv.ax AS px, sv.ay AS py, sv.az AS pz, uv.* FROM uv, sv')})
UNION ALL SELECT unit, 0 FROM ({_MEET}) WHERE {_dot('n', 'c')} * {_dot('n', 'd')} < 0 AND {_dot('m', 'a')} * {_dot('m', 'e')} < 0 AND {_dot('n', 'c')} * {_dot('m', 'a')} < 0),
pl AS (SELECT s_suppkey AS place, s_suppkey % 25 AS unit, w + 3 + s_suppkey % 10 AS lon, s + 13 + s_suppkey % 7 AS lat FROM supplier JOIN b ON polygon = s_suppkey % 25),
spot AS (SELECT place, arg_min([mx, my, mz], [round(km, 9), mx, my, mz]) AS m FROM ({_arc_sql(f"SELECT place, {_vector('lat', 'lon', 'p')}, uv.* FROM pl JOIN uv USING (unit)")}) GROUP BY 1),
edge AS (SELECT place, min(km) AS km FROM ({_arc_sql('SELECT place, m[1] AS px, m[2] AS py, m[3] AS pz, sv.* FROM spot, sv')}) GROUP BY 1)
SELECT place, unit, CASE WHEN g <= 500 THEN round(g, 4) END AS outline_km, CASE WHEN edge.km <= 500 THEN round(edge.km, 4) END AS edge_km FROM pl JOIN (SELECT unit, min(km) AS g FROM gap GROUP BY 1) USING (unit) JOIN edge USING (place)""")
def r14(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    nation, w, s, _, _ = _sides(t)
    at = nation.select(F.col("n_nationkey").alias("unit"), w.alias("_w"), s.alias("_s"))
    places = t.supplier.select(k.alias("place"), (k % 25).alias("unit")).join(F.broadcast(at), "unit").select("place", "unit", (F.col("_s") + 13 + F.col("place") % 7).alias("lat"), (F.col("_w") + 3 + F.col("place") % 10).alias("lon"))
    return rounded(outlines.coast_distances(places, _units(t), _areas(t), "place", "unit", "area", near_km=500.0), 4)


@query("R14_outline_length", f"WITH {BOX}, {ARCS} SELECT area, round(sum(2 * 6371.0088 * asin(sqrt(sin(radians(q[2] - p[2]) / 2) ** 2 + cos(radians(p[2])) * cos(radians(q[2])) * sin(radians(q[1] - p[1]) / 2) ** 2))), 4) AS km FROM sg GROUP BY 1")
def r14l(t: Tables) -> DataFrame:
    return rounded(outlines.lengths(_areas(t), "area"), 4)


# --- entry points -------------------------------------------------------------------------------------------------------------

#: Queries of three kinds over the bricks: a point in each, a ring around each, and a box that is moved by a third of a brick.
@query("P4_entry_points", f"""WITH {BRICKS}, po AS (SELECT u, x + 10 / 3.0 AS w, y + 2.5 AS s FROM g),
sets AS (SELECT u AS query_id, NULL::BIGINT AS member, 'single_unit' AS scope, u AS unit_id, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS inside FROM g
UNION ALL SELECT 100 + i, j, 'ring', j, 1.0, 1.0 FROM e UNION ALL SELECT 100 + u, u, 'ring', u, 1.0, 1.0 FROM g WHERE u IN (SELECT i FROM e)
UNION ALL SELECT 200 + po.u, NULL, 'polygon', g.u, o / (radians(10) * (sin(radians(s + 10)) - sin(radians(s)))), o / (radians(10) * (sin(radians(y + 10)) - sin(radians(y)))) FROM po, g,
 LATERAL (SELECT radians(greatest(0, least(w, x) + 10 - greatest(w, x))) * greatest(0, sin(radians(least(s, y) + 10)) - sin(radians(greatest(s, y)))) AS o) WHERE o > 1e-9)
SELECT query_id, member, scope, unit_id, round(weight, 6) AS weight, round(inside, 6) AS inside FROM sets""")
def p4(t: Tables) -> DataFrame:
    units, u = bricks(t), F.col("u")
    at = units.select(u.alias("query_id"), (F.col("lat") + 1).alias("lat"), (F.col("lon") - 1).alias("lon"))
    w, s = F.col("lon") - 5 + 10 / 3, F.col("lat") - 5 + 2.5
    polygons = units.select((u + 200).alias("query_id"), box_of(w, s, w + 10, s + 10).alias("ring"))
    return rounded(entry.resolve(units, "u", points=at, polygons=polygons, rings=at.withColumn("query_id", F.col("query_id") + 100), edges=outlines.touching(units, "u")))


@query("P4_signatures")
def p4s(t: Tables) -> DataFrame:
    """Buffers, rings, points and polygons through one plan: mean balance of the bricks' nations by percentile, in full form."""
    units, u = bricks(t), F.col("u")
    at = units.select(u.alias("query_id"), (F.col("lat") + 1).alias("lat"), (F.col("lon") - 1).alias("lon"))
    buffers = at.select((F.col("query_id") + 300).alias("query_id"), "lat", "lon", F.lit(700.0).alias("km"))
    polygons = units.select((u + 200).alias("query_id"), "ring")
    sets = entry.resolve(units, "u", at, buffers, polygons, at.withColumn("query_id", F.col("query_id") + 100), outlines.touching(units, "u"))
    # a ring's members are signatures of their own
    sets = sets.withColumn("query_id", F.concat_ws(":", "query_id", "member"))
    means = t.customer.groupBy(F.col("c_nationkey").alias("unit_id")).agg(F.avg("c_acctbal").alias("acctbal"), F.count("*").cast("double").alias("customers"))
    scores = position.scores_long(means, "unit_id", ["acctbal", "customers"])
    rows = blocks.area_weighted(sets.join(scores, "unit_id"))
    detail = ["p10", "p25", "p75", "p90", "spread", "iqr", "weight_at_zero", "core_share", "window_lo", "window_hi"]
    full = blocks.projected(rounded(rows), detail, with_detail=True)
    return full.join(sets.select("query_id", "scope").distinct(), "query_id").select("query_id", "scope", "variable", "method", "status", "n_units", "coverage", "representative_score", F.to_json("detail").alias("detail"))


@query("B5c_companions", "WITH " + sig.W + " SELECT query_id, variable, unit_id, round(weight, 6) AS weight, round(score, 4) AS score FROM r WHERE score IS NOT NULL")
def b5c(t: Tables) -> DataFrame:
    return blocks.companions(sig.rows(t))


# --- points -------------------------------------------------------------------------------------------------------------------

BANDS: point.Bands = {
    "A": ("Ground", [("elev_min", "lowest"), ("elev_max", "highest"), ("elev_point", "at the point"), ("relief_position", "place in the relief")]),
    "B": ("Water", [("runoff", "runoff"), ("discharge", "discharge")]),
    "C": ("Life", [("ecoregion", "ecoregion"), ("biome", "biome")]),
    "D": ("People", [("absent", "absent")]),
}
QUICK = [("ecoregion", "Ecoregion"), ("elev_point", "Elevation"), ("absent", "Absent"), ("runoff", "Runoff")]

POINT = f"""{BOX}, {ASKED}, cu AS (SELECT c_nationkey AS k, min(c_acctbal) AS elev_min, max(c_acctbal) AS elev_max, count(*)::DOUBLE AS runoff, CASE WHEN c_nationkey % 4 <> 0 THEN count(*) / 10.0 END AS discharge FROM customer GROUP BY 1),
cv AS (SELECT query_id, arg_min(polygon, [h, polygon]) AS unit FROM q JOIN b ON lon >= w AND lon < w + 40 AND lat >= s AND lat < s + 35 + h GROUP BY 1),
ps AS (SELECT query_id, q.lat, q.lon, q.lat * 100 AS elev_point, unit, elev_min, elev_max, runoff, discharge, n_name AS ecoregion, r_name AS biome, elev_max - elev_min AS relief_range,
  CASE WHEN elev_max > elev_min THEN greatest(0, least(1, (q.lat * 100 - elev_min) / (elev_max - elev_min))) END AS relief_position FROM cv JOIN q USING (query_id) JOIN nation ON n_nationkey = unit JOIN region ON r_regionkey = n_regionkey LEFT JOIN cu ON k = unit)"""


def _signature(t: Tables) -> DataFrame:
    of = t.customer.groupBy(F.col("c_nationkey").alias("unit")).agg(F.min("c_acctbal").alias("elev_min"), F.max("c_acctbal").alias("elev_max"), F.count("*").cast("double").alias("runoff"))
    of = of.withColumn("discharge", F.when(F.col("unit") % 4 != 0, F.col("runoff") / 10))
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("ecoregion"), F.col("r_name").alias("biome"))
    units = _boxes(t).withColumnRenamed("polygon", "unit").join(named, "unit").join(of, "unit", "left")
    return point.point_signature(_asked(t).withColumn("elev_point", F.col("lat") * 100), units, "query_id", "unit", "elev_min", "elev_max")


@query("N1_point_signature", f"WITH {POINT} SELECT query_id, unit, lat, lon, elev_point, elev_min, elev_max, runoff, discharge, ecoregion, biome, round(relief_range, 6) AS relief_range, round(relief_position, 6) AS relief_position FROM ps")
def n1(t: Tables) -> DataFrame:
    return rounded(_signature(t))


def _items_sql() -> str:
    out = []
    for letter, (label, fields) in BANDS.items():
        for i, (k, name) in enumerate([f for f in fields if f[0] != "absent"], 1):
            text = k in ("ecoregion", "biome")
            out.append(f"SELECT query_id, '{letter}' AS band, '{label}' AS label, {i} AS place, '{k}' AS field, '{name}' AS field_label, {k if text else 'NULL'} AS text, {'NULL' if text else f'round({k}, 6)'} AS number FROM ps")
    return " UNION ALL ".join(out)


@query("N5_bands", f"WITH {POINT} {_items_sql()}")
def n5(t: Tables) -> DataFrame:
    rows = point.banded(_signature(t), "query_id", BANDS).select("query_id", "band", "label", F.posexplode("items").alias("place", "i"))
    return rounded(rows.select("query_id", "band", "label", (F.col("place") + 1).alias("place"), F.col("i.key").alias("field"), F.col("i.label").alias("field_label"), F.col("i.text").alias("text"), F.col("i.number").alias("number")))


@query("N5_summary", f"""WITH {POINT} SELECT query_id, 1 AS place, 'ecoregion' AS key, 'Ecoregion' AS label, ecoregion AS text, NULL::DOUBLE AS number FROM ps
UNION ALL SELECT query_id, 2, 'elev_point', 'Elevation', NULL, elev_point FROM ps UNION ALL SELECT query_id, 3, 'runoff', 'Runoff', NULL, runoff FROM ps""")
def n5s(t: Tables) -> DataFrame:
    return rounded(point.summary(_signature(t), "query_id", QUICK))


_N = "coalesce(round({0}, {1})::DECIMAL(38,{1})::VARCHAR, 'n/a')"


@query("N8_digest", f"""WITH {POINT} SELECT query_id, array_to_string(['Signature of point ' || query_id, 'A: Ground', '  lowest: ' || {_N.format('elev_min', 0)}, '  highest: ' || {_N.format('elev_max', 0)}, '  at the point: ' || {_N.format('elev_point', 0)},
'  place in the relief: ' || {_N.format('relief_position', 2)}, 'B: Water', '  runoff: ' || {_N.format('runoff', 0)}, '  discharge: ' || {_N.format('discharge', 1)}, 'C: Life', '  ecoregion: ' || ecoregion, '  biome: ' || biome], chr(10)) AS digest FROM ps""")
def n8(t: Tables) -> DataFrame:
    return point.digest(_signature(t), "query_id", F.concat(F.lit("Signature of point "), F.col("query_id").cast("string")), BANDS, {"relief_position": 2, "discharge": 1})


@query("Z7_points_of_a_continent", f"WITH {PLACED}, {BOX} SELECT unit, polygon AS country FROM p JOIN b ON lon + 0.5 >= w AND lon + 0.5 < w + 40 AND lat + 0.5 >= s AND lat + 0.5 < s + 35 + h JOIN nation ON n_nationkey = polygon JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'AFRICA'")
def z7(t: Tables) -> DataFrame:
    of = t.nation.join(F.broadcast(t.region.where("r_name = 'AFRICA'")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("polygon"))
    points = placed(t).select("unit", (F.col("lon") + 0.5).alias("x"), (F.col("lat") + 0.5).alias("y"))
    return geometry.points_in_polygons(points, _boxes(t).join(of, "polygon"), "x", "y", "polygon").select("unit", F.col("polygon").alias("country"))


@query("Z11_grid_series", f"""WITH {ASKED}, g AS (SELECT l_suppkey % 45 * 4 - 90.0 AS lat, l_partkey % 90 * 4.0 AS lon, year(l_shipdate)::BIGINT AS year, l_quantity AS v FROM lineitem), la AS (SELECT DISTINCT lat AS a FROM g), lo AS (SELECT DISTINCT lon AS a FROM g),
c AS (SELECT query_id, (SELECT arg_min(a, [round(abs(a - q.lat), 9), a]) FROM la) AS cell_lat, (SELECT arg_min(a, [round(abs(a - (q.lon + 360) % 360), 9), a]) FROM lo) AS cell_lon FROM q)
SELECT query_id, cell_lat, cell_lon, year, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS spread FROM c JOIN g ON lat = cell_lat AND lon = cell_lon WHERE year BETWEEN 1993 AND 1997 GROUP BY 1, 2, 3, 4""")
def z11(t: Tables) -> DataFrame:
    runs = t.lineitem.select((F.col("l_suppkey") % 45 * 4 - 90.0).alias("lat"), (F.col("l_partkey") % 90 * 4.0).alias("lon"), F.year("l_shipdate").cast("long").alias("year"), F.col("l_linenumber").alias("member"), F.col("l_quantity").cast("double").alias("value"))
    return rounded(point.grid_series(_asked(t), runs, "query_id", 1993, 1997))


@query("Y12_profile_units", """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 100 / 100.0 END AS conc, list_transform(range(12), lambda i: ((c_custkey * (i + 3)) % 29)::DOUBLE) AS curve,
  CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 3)::DOUBLE END AS lake, CASE WHEN c_custkey % 5 <> 0 OR c_custkey % 2 = 0 THEN (c_custkey % 4)::DOUBLE END AS wet, c_custkey % 6 AS n, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 8 / 2.0 END AS edge FROM customer),
m AS (SELECT *, list_position(curve, list_max(curve)) AS mo, CASE WHEN conc < 0.15 THEN 'even' WHEN conc < 0.35 THEN 'moderate' WHEN conc < 0.6 THEN 'clear' ELSE 'strong' END AS cl FROM c),
r AS (SELECT k, 'S2.1b' AS rule, CASE WHEN conc IS NULL OR k % 13 = 0 THEN 'no_monthly_values' END AS reason, cl || CASE WHEN cl = 'even' THEN '' ELSE ', month ' || mo END AS named FROM m
UNION ALL SELECT k, 'S3.4', CASE WHEN lake IS NULL AND wet IS NULL THEN 'no_value' WHEN NOT (coalesce(lake > 0, false) OR coalesce(wet > 0, false)) THEN 'none_recorded' END, concat_ws(', ', CASE WHEN lake > 0 THEN 'lakes' END, CASE WHEN wet > 0 THEN 'wetlands' END) FROM m
UNION ALL SELECT k, 'S1.4', CASE WHEN n = 0 THEN 'no_region' WHEN n = 1 THEN 'no_other_region' END, array_to_string(list_transform(range(1, n), lambda i: 'region ' || i), ', ') FROM m
UNION ALL SELECT k, 'S7.3', CASE WHEN NOT coalesce(edge <= 2, false) THEN 'not_the_coast' END, 'nearest edge is the coast' FROM m)
SELECT k, rule, reason IS NULL AS applies, reason, CASE WHEN reason IS NULL THEN named END AS named FROM r""")
def y12(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    curve = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((k * (i + 3)) % 29).cast("double"))
    others = F.when(k % 6 == 0, None).when(k % 6 == 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (k % 6 - 1).cast("int"))), lambda i: F.concat(F.lit("region "), i.cast("string"))))
    rows = t.customer.select(
        k.alias("k"), F.when(k % 7 != 0, k % 100 / 100).alias("concentration"), F.when(k % 13 != 0, curve).alias("curve"), F.when(k % 5 != 0, (k % 3).cast("double")).alias("lake"),
        F.when((k % 5 != 0) | (k % 2 == 0), (k % 4).cast("double")).alias("wetland"), others.alias("others"), F.when(k % 11 != 0, k % 8 / 2).alias("edge_km"),
    )
    return statements.profile_units(rows, ["k"])


@query("R2_centroids", f"""WITH {AREA}, c AS (SELECT area, sum(sg * (x1 - x0) * (y1 - y0)) AS a, sum(sg * (x1 - x0) * (y1 - y0) * (x0 + x1) / 2) AS mx, sum(sg * (x1 - x0) * (y1 - y0) * (y0 + y1) / 2) AS my FROM pc GROUP BY 1)
SELECT area, round(mx / a, 6) AS x, round(my / a, 6) AS y, round(a, 6)::DOUBLE AS square_degrees, true AS surface_inside FROM c""")
def r2c(t: Tables) -> DataFrame:
    """Centroids, and whether the point on the surface, which a centroid need not be, lies inside."""
    areas = _areas(t)
    on = areas.select("area", shapes.point_on_surface(F.col("shape")).alias("s"), "shape").select("area", shapes.inside(F.col("s.x"), F.col("s.y"), F.col("shape")).alias("surface_inside"))
    return rounded(shapes.centroids(areas, "area").join(on, "area"))


#: A line of three points for each nation, of a class from 1 to 7, and places in small boxes.
RIVERS = """rv AS (SELECT n_nationkey AS river, 1 + n_nationkey * 5 % 7 AS class, [[n_nationkey * 25 % 320 - 172.0, n_nationkey % 4 * 30 - 60.0], [n_nationkey * 25 % 320 - 165.5, n_nationkey % 4 * 30 - 47.0], [n_nationkey * 25 % 320 - 150.0, n_nationkey % 4 * 30 - 40.0]] AS path FROM nation),
re AS (SELECT river, class, path[i] AS p, path[i + 1] AS q FROM rv, (SELECT unnest([1, 2]) AS i)), rs AS (SELECT river, class, p, q, {a}, {e} FROM re)""".format(a=_vector("p[2]", "p[1]", "a"), e=_vector("q[2]", "q[1]", "e"))


@query("R12_rivers", f"""WITH {BOX}, {RIVERS}, ub AS (SELECT polygon AS unit, w + 2 AS w, s + 12 AS s, w + 9 AS e, s + 30 AS n FROM b),
cl AS (SELECT river, class, unit, p, q, greatest(0, (w - p[1]) / (q[1] - p[1]), (s - p[2]) / (q[2] - p[2])) AS t0, least(1, (e - p[1]) / (q[1] - p[1]), (n - p[2]) / (q[2] - p[2])) AS t1 FROM re, ub),
le AS (SELECT river, class, unit, sum(2 * 6371.0088 * asin(sqrt(sin(radians((q[2] - p[2]) * (t1 - t0)) / 2) ** 2 + cos(radians(p[2] + (q[2] - p[2]) * t0)) * cos(radians(p[2] + (q[2] - p[2]) * t1)) * sin(radians((q[1] - p[1]) * (t1 - t0)) / 2) ** 2))) AS km FROM cl WHERE t1 > t0 GROUP BY 1, 2, 3),
own AS (SELECT unit, min(class) AS own_class FROM le WHERE km > 1 GROUP BY 1),
pl AS (SELECT s_suppkey AS place, s_suppkey % 25 AS unit, w + 1 + s_suppkey % 10 AS lon, s + 1 + s_suppkey % 7 AS lat FROM supplier JOIN ub ON unit = s_suppkey % 25), pv AS (SELECT place, own_class, {_vector('lat', 'lon', 'p')} FROM pl LEFT JOIN own USING (unit)),
d AS (SELECT place, own_class, river, class, min(km) AS km FROM ({_arc_sql('SELECT pv.*, river, class, ax, ay, az, ex, ey, ez FROM pv, rs')}) GROUP BY 1, 2, 3, 4),
n AS (SELECT place, arg_min(river, [round(km, 6), river]) AS river, arg_min(class, [round(km, 6), river]) AS class, min(km) AS km FROM d WHERE class <= 5 GROUP BY 1),
l AS (SELECT place, arg_min(river, [round(km, 6), river]) AS larger, arg_min(class, [round(km, 6), river]) AS larger_class, min(km) AS larger_km FROM d WHERE class <= own_class - 2 AND km <= 600 GROUP BY 1)
SELECT place, own_class, river, class, round(km, 4) AS km, larger, larger_class, round(larger_km, 4) AS larger_km FROM pv LEFT JOIN n USING (place) LEFT JOIN l USING (place)""")
def r12r(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = (k * 25 % 320).cast("double"), (k % 4 * 30).cast("double")
    path = F.array(corner(x - 172, y - 60), corner(x - 165.5, y - 47), corner(x - 150, y - 40))
    rivers = t.nation.select(k.alias("river"), (1 + k * 5 % 7).cast("int").alias("class"), path.alias("path"))
    nation, w, s, _, _ = _sides(t)
    at = nation.select(k.alias("unit"), (w + 2).alias("_w"), (s + 12).alias("_s"))
    n = F.col("s_suppkey")
    places = t.supplier.select(n.alias("place"), (n % 25).alias("unit")).join(F.broadcast(at), "unit").select("place", "unit", (F.col("_s") + 1 + F.col("place") % 7).alias("lat"), (F.col("_w") + 1 + F.col("place") % 10).alias("lon"))
    return rounded(outlines.rivers_near(places, _units(t), rivers, "place", "unit", "river", 5, larger_km=600.0, start_km=800.0), 4)
