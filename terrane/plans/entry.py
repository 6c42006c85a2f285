"""Entry points over the provided tables: nations and single customers as queries, resolvers and distance joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import blocks, entry, geometry, outlines, position, weighted
from terrane.plans import signature as sig
from terrane.plans.curves import HAV, PLACED, placed
from terrane.plans.registry import Tables, query, rounded
from terrane.plans.spatial import AREA, _areas, _boxes, box_of

CATALOG = [("acctbal", "A", "continuous", "continental-gradient"), ("surplus", "B", "continuous", None), ("n_orders", "B", "continuous", "network-topology"), ("segment", "C", "categorical", None), ("coast", "D", "flag", None)]


def sets(t: Tables) -> DataFrame:
    """Nations with what a third of them lacks, and each hundredth customer as a query of one unit."""
    k = F.col("query_id")
    areas = sig.weights(t).select("query_id", "unit_id", (F.col("weight") * F.when(k % 3 == 0, 0.9).otherwise(1.0)).alias("weight"))
    single = t.customer.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 1000).alias("query_id"), F.col("c_custkey").alias("unit_id"), F.lit(1.0).alias("weight"))
    return areas.unionByName(single).withColumn("inside", F.col("unit_id") % 10 / 10 + 0.05)


def scopes(sets_: DataFrame) -> DataFrame:
    k = F.col("query_id")
    return sets_.select("query_id").distinct().withColumn("scope", F.when(k >= 1000, "single_unit").when(k % 2 == 0, "buffer").otherwise("polity"))


SETS = """
WITH w AS (SELECT c_nationkey AS query_id, c_custkey AS unit_id, sum(o_totalprice::DECIMAL(18,2)) AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
ws AS (SELECT query_id, unit_id, spent::DOUBLE / (sum(spent) OVER (PARTITION BY query_id))::DOUBLE * CASE WHEN query_id % 3 = 0 THEN 0.9 ELSE 1 END AS weight FROM w
       UNION ALL SELECT 1000 + c_custkey, c_custkey, 1.0 FROM customer WHERE c_custkey % 100 = 0),
sk AS (SELECT query_id, count(*) AS units, CASE WHEN query_id >= 1000 THEN 'single_unit' WHEN query_id % 2 = 0 THEN 'buffer' ELSE 'polity' END AS scope FROM ws GROUP BY 1)"""
#: What sig.W has after its weights.
VALUES = sig.W[sig.W.index("\nno AS"):]


@query("R11_scope", SETS + """
SELECT query_id, count(*) AS n_units, greatest(0, round(1 - sum(weight), 6)) AS shortfall, round(sum(CASE WHEN unit_id % 10 / 10.0 + 0.05 < 0.5 THEN weight ELSE 0 END), 6) AS lt_half,
       round(sum(CASE WHEN unit_id % 10 / 10.0 + 0.05 < 0.2 THEN weight ELSE 0 END), 6) AS lt_fifth FROM ws GROUP BY 1""")
def r11(t: Tables) -> DataFrame:
    return rounded(entry.scope_of(sets(t)))


PIPELINE = SETS + "," + VALUES + sig.CUM + sig.QS + sig.CORE + sig.ZF + sig.MODES + """,
fl AS (SELECT query_id, count(*) AS n, sum(weight * CASE WHEN unit_id % 3 = 0 THEN 1 ELSE 0 END) AS share FROM ws GROUP BY 1),
lb AS (SELECT query_id, ws.unit_id, weight, CASE WHEN ws.unit_id % 13 <> 0 THEN segment END AS label FROM ws JOIN va ON va.unit_id = ws.unit_id)""" + sig.P + """,
mc AS (SELECT query_id, min(label) AS modal, max(share) AS ms FROM p JOIN (SELECT query_id, max(share) AS top FROM p GROUP BY 1) USING (query_id) WHERE share = top GROUP BY 1),
ar AS (SELECT query_id, variable, scope, units, coverage, d.n_units, mean, coherence, modality,
         CASE WHEN coverage < 1e-9 THEN 'no_data' WHEN variable = 'acctbal' AND zero_fraction >= 0.2 AND weight_at_zero >= 0.9 THEN 'outside_active_domain' ELSE 'ok' END AS status
       FROM b JOIN sk USING (query_id) LEFT JOIN d USING (query_id, variable) LEFT JOIN mo USING (query_id, variable) JOIN zf USING (variable) WHERE variable <> 'n_orders'),
rw AS (SELECT query_id, variable, max(raw) AS raw FROM r GROUP BY 1, 2),
tp AS (SELECT query_id, arg_max(unit_id, [coalesce(raw, '-Infinity'::DOUBLE), -unit_id]) AS unit_id FROM r WHERE variable = 'n_orders' GROUP BY 1),
al AS (SELECT query_id, scope, variable, CASE variable WHEN 'acctbal' THEN 'A' ELSE 'B' END AS band, CASE variable WHEN 'acctbal' THEN 'area_weighted' ELSE 'distribution_only' END AS method, status, coalesce(n_units, 0)::BIGINT AS n_units, round(coverage, 6) AS coverage,
         CASE WHEN status = 'ok' AND NOT (scope <> 'polity' AND modality = 'two_regime') THEN round(mean, 6) END AS representative_score, CASE WHEN status = 'ok' AND units = 1 THEN round(raw, 3) END AS representative_raw, NULL AS modal_class,
         status = 'ok' AND scope <> 'polity' AND coalesce(modality, '') = 'two_regime' AS suppressed, CASE WHEN status = 'ok' AND units >= 5 THEN coherence END AS coherence FROM ar JOIN rw USING (query_id, variable)
UNION ALL SELECT query_id, scope, 'n_orders', 'B', 'dominant_unit', CASE WHEN scope = 'polity' THEN 'not_areal' WHEN raw IS NULL THEN 'no_data' ELSE 'ok' END, units, NULL, CASE WHEN scope <> 'polity' THEN round(score, 6) END, CASE WHEN scope <> 'polity' THEN raw END, NULL, false, NULL
  FROM tp JOIN r USING (query_id, unit_id) JOIN sk USING (query_id) WHERE variable = 'n_orders'
UNION ALL SELECT query_id, scope, 'segment', 'C', 'class_mixture', CASE WHEN coverage < 1e-9 THEN 'no_data' WHEN coverage < 0.5 THEN 'low_coverage' ELSE 'ok' END, n_units, round(coverage, 6), NULL, NULL, modal, false, CASE WHEN ms >= 0.85 THEN 'concentrated' WHEN ms IS NOT NULL THEN 'mixed' END
  FROM cv JOIN sk USING (query_id) LEFT JOIN mc USING (query_id)
UNION ALL SELECT query_id, scope, 'coast', 'D', 'flag_fraction', 'ok', n, NULL, NULL, round(share, 6), NULL, false, NULL FROM fl JOIN sk USING (query_id))
SELECT * FROM al"""


def _signatures(t: Tables) -> DataFrame:
    units = sig.variables(t)
    scores = position.scores_long(units, "unit_id", sig.VARIABLES)
    zeros = position.neutral_long(units, "unit_id", sig.VARIABLES).groupBy("variable").agg(weighted.zero_fraction("raw").alias("zero_fraction"))
    catalog = t.spark.createDataFrame(CATALOG, "variable string, band string, kind string, cluster string").join(zeros, "variable", "left")
    u = F.col("unit_id")
    labels = units.select(u, F.lit("segment").alias("variable"), F.when(u % 13 != 0, F.col("segment")).alias("label"))
    flags = units.select(u, F.lit("coast").alias("variable"), F.when(u % 3 == 0, 1).otherwise(0).alias("flag"))
    s = sets(t)
    return rounded(entry.signatures(s, scopes(s), scores, labels, flags, catalog, "n_orders"))


@query("P3_signature_pipeline", PIPELINE)
def p3(t: Tables) -> DataFrame:
    return _signatures(t)


@query("P1_band_filter", PIPELINE.replace("SELECT * FROM al", "SELECT query_id, variable, band, method, status, representative_score FROM al WHERE band IN ('A', 'C')"))
def p1(t: Tables) -> DataFrame:
    return blocks.band_filter(_signatures(t), "ca").select("query_id", "variable", "band", "method", "status", "representative_score")


@query("B0d_dispatch", """SELECT * FROM (VALUES ('acctbal', 'area_weighted'), ('surplus', 'distribution_only'), ('n_orders', 'dominant_unit'), ('segment', 'class_mixture'), ('coast', 'flag_fraction'), ('odd', 'unknown')) x(variable, method)""")
def b0d(t: Tables) -> DataFrame:
    catalog = t.spark.createDataFrame([*CATALOG, ("odd", "E", "continuous", "else")], "variable string, band string, kind string, cluster string")
    return catalog.select("variable", blocks.dispatch(F.col("kind"), F.col("cluster")).alias("method"))


@query("R3_resolve_polity", f"""WITH {AREA}, q AS (SELECT s_suppkey AS query_id, 'p' || s_suppkey % 5 AS name, s_suppkey % 40 AS year FROM supplier), sl AS (SELECT polygon AS slice, 'p' || polygon % 5 AS name, polygon AS low, 20 + 2 * polygon AS high FROM b),
a AS (SELECT query_id, arg_min(slice, [high - low, slice]) AS slice FROM q JOIN sl USING (name) WHERE year BETWEEN low AND high GROUP BY 1)
SELECT query_id, slice, unit, round(o / sz.z, 6) AS weight, round(o / ub.z, 6) AS inside FROM a JOIN ov ON ov.area = slice JOIN sz USING (area) JOIN ub USING (unit)""")
def r3(t: Tables) -> DataFrame:
    k, p = F.col("s_suppkey"), F.col("area")
    asked = t.supplier.select(k.alias("query_id"), F.concat(F.lit("p"), k % 5).alias("name"), (k % 40).alias("year"))
    slices = _areas(t).select(p.alias("slice"), F.concat(F.lit("p"), p % 5).alias("name"), p.alias("low"), (20 + 2 * p).alias("high"), "shape")
    return rounded(entry.resolve_polity(asked, slices, _boxes(t).withColumnRenamed("polygon", "unit"), "unit"))


@query("R4_resolve_crosswalk", """WITH x AS (SELECT l_suppkey AS polity, l_partkey AS unit_id, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY 1, 2), c AS (SELECT polity, unit_id, q / sum(q) OVER (PARTITION BY polity) AS weight FROM x),
q AS (SELECT s_suppkey * 10 AS query_id, s_suppkey AS polity FROM supplier) SELECT query_id, polity, unit_id, round(weight, 6) AS weight, (row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, unit_id))::INTEGER AS place FROM q JOIN c USING (polity) WHERE weight >= 0.001""")
def r4(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy(F.col("l_suppkey").alias("polity"), F.col("l_partkey").alias("unit_id")).agg(F.sum("l_quantity").cast("double").alias("q"))
    whole = sums.groupBy("polity").agg(F.sum("q").alias("_all"))
    crosswalk = sums.join(whole, "polity").select("polity", "unit_id", (F.col("q") / F.col("_all")).alias("weight"))
    asked = t.supplier.select((F.col("s_suppkey") * 10).alias("query_id"), F.col("s_suppkey").alias("polity"))
    return rounded(entry.resolve_crosswalk(asked, crosswalk, least=0.001).select("query_id", "polity", "unit_id", "weight", "place"))


#: Units in rows of five; the second and third row are moved by half a unit, so some share parts of edges and some meet in a point.
BRICKS = """g AS (SELECT n_nationkey AS u, (n_nationkey % 5) * 10.0 + CASE WHEN n_nationkey // 5 IN (1, 2) THEN 5 ELSE 0 END AS x, (n_nationkey // 5) * 10.0 AS y, n_nationkey % 7 AS area FROM nation),
t AS (SELECT a.u AS i, b.u AS j, greatest(a.x, b.x) AS x0, least(a.x, b.x) + 10 AS x1, greatest(a.y, b.y) AS y0, least(a.y, b.y) + 10 AS y1 FROM g a JOIN g b ON a.u <> b.u),
e AS (SELECT i, j, (x0 + x1) / 2 AS ex, (y0 + y1) / 2 AS ey, 6371.0088 * CASE WHEN x1 > x0 THEN 2 * asin(sin(radians(x1 - x0) / 2) * cos(radians(y0))) ELSE radians(y1 - y0) END AS shared_km FROM t WHERE (x1 = x0 AND y1 >= y0) OR (y1 = y0 AND x1 >= x0))"""


def bricks(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    row = F.floor(k / 5)
    x, y = (k % 5) * 10.0 + F.when(row.isin(1, 2), 5.0).otherwise(0.0), row * 10.0
    return t.nation.select(k.alias("u"), box_of(x, y, x + 10, y + 10).alias("ring"), (k % 7).alias("area"), (y + 5).cast("double").alias("lat"), (x + 5).alias("lon"))


@query("R6_shared_borders", f"WITH {BRICKS} SELECT i, j, round(shared_km, 4) AS shared_km, ey::DOUBLE AS mid_lat, ex::DOUBLE AS mid_lon FROM e")
def r6b(t: Tables) -> DataFrame:
    return rounded(outlines.touching(bricks(t), "u"), 4)


def _bearing_sql(la: str, lo: str, lb: str, mo: str) -> str:
    la, lo, lb, mo = (f"({x})" for x in (la, lo, lb, mo))
    d = f"radians({mo} - {lo})"
    return f"round((degrees(atan2(sin({d}) * cos(radians({lb})), cos(radians({la})) * sin(radians({lb})) - sin(radians({la})) * cos(radians({lb})) * cos({d}))) + 360) % 360, 4)"


@query("R6_resolve_ring", f"""WITH {BRICKS}, q AS (SELECT n_nationkey AS query_id, n_nationkey AS centre FROM nation)
SELECT query_id, centre, j AS neighbour, round(shared_km, 4) AS shared_km, {_bearing_sql('a.y + 5', 'a.x + 5', 'ey', 'ex')} AS border_bearing, {_bearing_sql('a.y + 5', 'a.x + 5', 'b.y + 5', 'b.x + 5')} AS centroid_bearing,
(row_number() OVER (PARTITION BY query_id ORDER BY b.area DESC, j))::INTEGER AS place FROM q JOIN e ON e.i = centre JOIN g a ON a.u = e.i JOIN g b ON b.u = e.j""")
def r6(t: Tables) -> DataFrame:
    units = bricks(t)
    asked = units.select(F.col("u").alias("query_id"), (F.col("lon") + 1).alias("lon"), (F.col("lat") - 1).alias("lat"))
    return rounded(entry.resolve_ring(asked, units, outlines.touching(units, "u"), "u"), 4)


ASKED = "q AS (SELECT s_suppkey AS query_id, (s_suppkey * 37 % 179 - 89.5)::DOUBLE AS lat, (s_suppkey * 53 % 361 - 180.5)::DOUBLE AS lon FROM supplier)"


def _asked(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("query_id"), (k * 37 % 179 - 89.5).cast("double").alias("lat"), (k * 53 % 361 - 180.5).cast("double").alias("lon"))


@query("J13_within_distance", f"WITH {PLACED}, {ASKED} SELECT query_id, unit, round({HAV.format(a='q', b='p')}, 4) AS km FROM q JOIN p ON {HAV.format(a='q', b='p')} <= 700")
def j13(t: Tables) -> DataFrame:
    return rounded(geometry.within_km(_asked(t), placed(t), "query_id", "unit", 700.0), 4)


@query("J15_nearest_points", f"WITH {PLACED}, {ASKED}, d AS (SELECT query_id, unit, {HAV.format(a='q', b='p')} AS km FROM q, p) SELECT query_id, unit, round(km, 4) AS km, r::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(km, 9), unit) AS r FROM d) WHERE r <= 3")
def j15(t: Tables) -> DataFrame:
    return rounded(geometry.nearest_points(_asked(t), placed(t), "query_id", "unit", 3), 4)


@query("R7_snap_to_unit", f"WITH {PLACED}, {ASKED}, d AS (SELECT query_id, unit, {HAV.format(a='q', b='p')} AS km FROM q, p) SELECT query_id, unit, round(km, 4) AS km FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(km, 9), unit) AS r FROM d WHERE km <= 150) WHERE r = 1")
def r7(t: Tables) -> DataFrame:
    return rounded(geometry.nearest_points(_asked(t), placed(t), "query_id", "unit", 1, most_km=150.0).drop("place"), 4)
