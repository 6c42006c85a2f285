"""Choices, classes and rates over the provided tables: best rows, two-stage search, class cells, grids and epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import curves, scalars
from terrane.operators import cluster, geometry, graph, lenses, lookup, position, series, spatialstats, statements, weighted
from terrane.plans.curves import HAV, MONTHS, PLACED, WHOLE, monthly, placed
from terrane.plans.registry import Tables, day_number, query, rounded
from terrane.plans.spatial import BOX, EDGES, PAIRS, _boxes, _edges, _pairs, _values, tree


@query("F4_month_value", "SELECT c_custkey, CASE WHEN c_custkey % 14 BETWEEN 1 AND 12 THEN ((c_custkey % 14) * (c_nationkey + 1))::DOUBLE END AS v FROM customer")
def f4(t: Tables) -> DataFrame:
    months = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: (m * (F.col("c_nationkey") + 1)).cast("double"))
    return t.customer.select("c_custkey", series.month_value(months, F.col("c_custkey") % 14).alias("v"))


@query("A20_best_row", "SELECT c_nationkey, arg_max(c_custkey, [c_acctbal, -c_custkey]) AS c_custkey, max(c_acctbal) AS c_acctbal FROM customer GROUP BY 1")
def a20(t: Tables) -> DataFrame:
    return lookup.best_row(t.customer, ["c_nationkey"], "c_acctbal", "c_custkey", ["c_acctbal"])


@query("A22_stratified_rates", """
WITH s AS (SELECT c_mktsegment AS g, count(*) AS n FROM customer GROUP BY 1), p AS (SELECT c_mktsegment AS g, count(*) AS m FROM customer WHERE c_custkey % 7 = 0 GROUP BY 1), c AS (SELECT unnest([0.0, 2500.0, 5000.0, 7500.0])::DOUBLE AS cutoff)
SELECT cutoff, round(sum(CASE WHEN c_acctbal >= cutoff THEN s.n / p.m::DOUBLE ELSE 0 END) / (SELECT sum(n) FROM s), 6) AS rate FROM customer JOIN s ON s.g = c_mktsegment JOIN p ON p.g = c_mktsegment, c WHERE c_custkey % 7 = 0 GROUP BY 1""")
def a22(t: Tables) -> DataFrame:
    # the sample is what the operator is about
    return rounded(weighted.stratified_rates(t.customer, t.customer.where("c_custkey % 7 = 0"), "c_mktsegment", "c_acctbal", [0.0, 2500.0, 5000.0, 7500.0]))


@query("O8_two_stage_search", """
WITH a AS (SELECT c_nationkey, c_custkey, c_acctbal, c_custkey % 97 AS b, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)
SELECT c_nationkey, c_custkey, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY b DESC, c_custkey) AS rank FROM a WHERE r <= 20) WHERE rank <= 5""")
def o8(t: Tables) -> DataFrame:
    scored = t.customer.select("c_nationkey", "c_custkey", "c_acctbal", (F.col("c_custkey") % 97).alias("b"))
    return lookup.two_stage(scored, ["c_nationkey"], "c_acctbal", "b", "c_custkey", 20, 5).select("c_nationkey", "c_custkey", "rank")


@query("W4_filtered_population_rank", """SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > 0 THEN round(100 * percent_rank() OVER (PARTITION BY c_acctbal > 0 ORDER BY c_acctbal), 6) END AS score FROM customer""")
def w4(t: Tables) -> DataFrame:
    some = position.percent_rank(t.customer.where("c_acctbal > 0").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "score")
    return rounded(t.customer.select("c_custkey", "c_acctbal").join(some, "c_custkey", "left"))


def _classes(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.select("p_partkey", scalars.binned(size, scalars.ARIDITY_EDGES, scalars.ARIDITY_LABELS).alias("a"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")).alias("b"))


CELLS = "k AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'hyper-arid' WHEN p_size < 20 THEN 'arid' WHEN p_size < 65 THEN 'semi-arid' WHEN p_size < 100 THEN 'sub-humid' ELSE 'humid' END || ' | ' || CASE WHEN p_partkey % 9 <> 0 THEN p_type END AS cell FROM part)"


@query("L9_class_cells", f"WITH {CELLS} SELECT cell, count(*) AS n FROM k GROUP BY 1")
def l9(t: Tables) -> DataFrame:
    return _classes(t).select(lenses.cell_key(F.col("a"), F.col("b")).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


@query("L10_class_lens", f"WITH {CELLS} SELECT q.p_partkey AS query_id, k.p_partkey FROM k q JOIN k ON q.cell = k.cell AND q.p_partkey <> k.p_partkey WHERE q.p_partkey IN (1, 2, 5, 9)")
def l10(t: Tables) -> DataFrame:
    cells = _classes(t).select("p_partkey", lenses.cell_key(F.col("a"), F.col("b")).alias("cell"))
    asked = t.part.where(F.col("p_partkey").isin(1, 2, 5, 9)).select(F.col("p_partkey").alias("query_id"))
    return lenses.class_lens(cells, asked, "p_partkey", "cell")


@query("L13_grid_relief", """SELECT l_partkey, count(*) AS n, min(v) AS low, max(v) AS high, max(v) - min(v) AS relief, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM (SELECT l_partkey, CASE WHEN l_linenumber <> 3 THEN l_quantity::DOUBLE END AS v FROM lineitem) WHERE v IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""")
def l13(t: Tables) -> DataFrame:
    points = t.lineitem.select("l_partkey", F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("double")).alias("v"))
    return rounded(lenses.relief(points, "l_partkey", "v"))


@query("L18_distance_pairs", """WITH m AS (SELECT c_nationkey AS k, avg(c_acctbal) / 1000 AS x, count(*) / 10.0 AS y FROM customer GROUP BY 1) SELECT a.k AS a, b.k AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance, round(1 / (1 + sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS similarity FROM m a JOIN m b ON a.k < b.k""")
def l18(t: Tables) -> DataFrame:
    means = t.customer.groupBy("c_nationkey").agg((F.avg("c_acctbal") / 1000).alias("x"), (F.count("*") / 10).alias("y"))
    return rounded(lenses.distance_pairs(means, "c_nationkey", ["x", "y"]))


@query("L21_mutual_information", """WITH l AS (SELECT vec_id % 4 AS a, label AS b FROM embeddings), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY 1, 2), x AS (SELECT a, sum(n) AS x FROM c GROUP BY 1), y AS (SELECT b, sum(n) AS y FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c)
SELECT round((SELECT sum(n / t * ln(n * t / (x * y))) FROM c JOIN x USING (a) JOIN y USING (b), t) / (((SELECT -sum(x / t * ln(x / t)) FROM x, t) + (SELECT -sum(y / t * ln(y / t)) FROM y, t)) / 2), 8) AS nmi""")
def l21(t: Tables) -> DataFrame:
    return cluster.mutual_information(t.embeddings.select((F.col("vec_id") % 4).alias("a"), F.col("label").alias("b")), "a", "b").select(F.round("nmi", 8).alias("nmi"))


@query("M20_degenerate_rates", """WITH g AS (SELECT l_suppkey % 3 AS scale, l_partkey, count(*) AS n, stddev_pop(l_linenumber) AS s FROM lineitem GROUP BY 1, 2) SELECT scale, count(*) AS n, count(*) FILTER (WHERE n = 1 OR s = 0) AS flat, round(count(*) FILTER (WHERE n = 1 OR s = 0) / count(*)::DOUBLE, 6) AS rate FROM g GROUP BY 1""")
def m20(t: Tables) -> DataFrame:
    groups = t.lineitem.groupBy((F.col("l_suppkey") % 3).alias("scale"), "l_partkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    flat = F.count_if((F.col("n") == 1) | (F.col("lo") == F.col("hi")))
    return rounded(groups.groupBy("scale").agg(F.count("*").alias("n"), flat.alias("flat"), (flat / F.count("*")).alias("rate")))


EPOCHS = "e AS (SELECT unit, k AS epoch, v * (k + 1) AS x FROM p, (SELECT unnest(range(0, 4)) AS k))"


@query("T5_epochs_by_centroid", f"WITH {PLACED}, {BOX}, {EPOCHS} SELECT polygon, epoch::INTEGER AS epoch, count(*) AS n, round(sum(x), 2) AS total, round(sum(x), 2) / count(*) AS mean, CASE WHEN count(*) > 1 THEN round(stddev_pop(x), 3) END AS sd, CASE WHEN count(*) > 1 THEN round(quantile_cont(x, 0.1), 3) END AS p10, CASE WHEN count(*) > 1 THEN round(quantile_cont(x, 0.9), 3) END AS p90 FROM p JOIN e USING (unit) JOIN b ON lon + 0.5 >= w AND lon + 0.5 < w + 40 AND lat + 0.5 >= s AND lat + 0.5 < s + 35 + h GROUP BY 1, 2")
def t5(t: Tables) -> DataFrame:
    values = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.col("v") * k)
    cells = placed(t).select("unit", (F.col("lon") + 0.5).alias("x"), (F.col("lat") + 0.5).alias("y"), values.alias("values"))
    inside = geometry.points_in_polygons(cells, _boxes(t), "x", "y", "polygon")
    steps = series.exploded(inside, ["polygon"], "values").withColumnRenamed("step", "epoch")
    spread = {"sd": F.stddev_pop("value"), "p10": F.percentile("value", 0.1), "p90": F.percentile("value", 0.9)}  # of more than one cell
    # the mean is left unrounded, as it often lies half-way between two places
    return steps.groupBy("polygon", "epoch").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), (F.round(F.sum("value"), 2) / F.count("*")).alias("mean"), *(F.when(F.count("*") > 1, F.round(x, 3)).alias(n) for n, x in spread.items()))


@query("T6_step_map", f"WITH {PLACED}, {BOX}, c AS (SELECT polygon, least(1.0, sum(abs(v) * 3) / 499979) AS fraction FROM p JOIN b ON lon + 0.5 >= w AND lon + 0.5 < w + 40 AND lat + 0.5 >= s AND lat + 0.5 < s + 35 + h GROUP BY 1) SELECT polygon, round(fraction, 6) AS fraction FROM b LEFT JOIN c USING (polygon)")
def t6(t: Tables) -> DataFrame:
    values = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.abs("v") * k)
    cells = placed(t).select("unit", (F.col("lon") + 0.5).alias("x"), (F.col("lat") + 0.5).alias("y"), values.alias("values"))
    boxes = _boxes(t)
    links = geometry.points_in_polygons(cells, boxes, "x", "y", "polygon").select("polygon", "unit", F.lit(1.0).alias("share"))
    steps = series.crosswalk_steps(cells.select("unit", "values"), links, "polygon", "unit", "values", "share", boxes.select("polygon", F.lit(499979.0).alias("area")), "area")
    return rounded(boxes.select("polygon").join(steps.where("step = 2").select("polygon", "fraction"), "polygon", "left"))


@query("T19_bin_ranges", "SELECT * FROM (VALUES (1, 1, 7), (2, 8, 10), (3, 11, 11), (4, 12, 21), (5, 22, 28), (6, 29, 48), (7, 49, 128)) x(bin, first, last)")
def t19(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(k, a, b) for k, (a, b) in series.STEP_BINS.items()], "bin int, first int, last int")


@query("Z4_share_of_polity", """WITH c AS (SELECT c_custkey AS cell, c_nationkey AS unit, abs(c_acctbal) AS v, CASE WHEN c_nationkey % 6 <> 0 THEN 10000.0 ELSE 0 END AS area FROM customer), u AS (SELECT unit, 100 * sum(v) / nullif(sum(area), 0) AS share FROM c GROUP BY 1)
SELECT n_regionkey AS polity, round(sum(share * (1 + n_nationkey)) / sum(CASE WHEN share IS NOT NULL THEN 1 + n_nationkey END), 6) AS share FROM u JOIN nation ON n_nationkey = unit GROUP BY 1""")
def z4(t: Tables) -> DataFrame:
    k = F.col("c_nationkey")
    cells = t.customer.select(F.col("c_custkey").alias("cell"), F.abs("c_acctbal").alias("v"), F.when(k % 6 != 0, 10000.0).otherwise(0.0).alias("area"))
    units = series.share_of_units(cells, t.customer.select(k.alias("unit"), F.col("c_custkey").alias("cell")), "unit", "cell", "v", "area")
    members = t.nation.select(F.col("n_regionkey").alias("polity"), F.col("n_nationkey").alias("unit"), (1.0 + F.col("n_nationkey")).alias("w"))
    return rounded(units.join(members, "unit").groupBy("polity").agg(weighted.wmean("share", "w").alias("share")))


@query("H7_circular_peaks", f"""WITH {MONTHS}, o AS (SELECT cell FROM k GROUP BY 1 {WHOLE}), c AS (SELECT cell, t, q::DOUBLE AS v FROM k JOIN o USING (cell)),
s AS (SELECT a.cell, a.t, a.v, d, n, b.v AS w FROM c a, (SELECT unnest([-1, 1]) AS d) x, (SELECT unnest(range(1, 13)) AS n) y JOIN c b ON b.cell = a.cell AND b.t = (a.t + d * n + 144) % 12),
f AS (SELECT cell, t, d, min(n) FILTER (WHERE w > v) AS stop FROM s GROUP BY 1, 2, 3), g AS (SELECT s.cell, s.t, s.v, d, min(w) FILTER (WHERE n < coalesce(stop, 99)) AS floor, max(w) FILTER (WHERE n = 1) AS next FROM s JOIN f USING (cell, t, d) GROUP BY 1, 2, 3, 4)
SELECT cell, t AS month, v AS value, v - max(floor) AS prominence FROM g GROUP BY cell, t, v HAVING max(next) <= v AND min(next) < v AND v - max(floor) >= 30""")
def h7(t: Tables) -> DataFrame:
    q = F.transform("q", lambda x: x.cast("double"))
    return monthly(t).select("cell", F.inline(curves.circular_peaks(q, 30.0)))


@query("F13_tiered_match", """WITH q AS (SELECT s_suppkey AS k, s_suppkey % 90 AS a, s_suppkey % 13 AS b FROM supplier), n AS (SELECT c_custkey AS id, c_custkey % 301 AS a, c_custkey % 29 AS b FROM customer),
m AS (SELECT k, 0 AS o, 'exact' AS tier, id FROM q JOIN n ON q.a = n.a AND q.b = n.b UNION ALL SELECT k, 1, 'first', id FROM q JOIN n ON q.a = n.a UNION ALL SELECT k, 2, 'second', id FROM q JOIN n ON q.b = n.b)
SELECT DISTINCT ON (k) k, tier, id FROM m ORDER BY k, o, id""")
def f13(t: Tables) -> DataFrame:
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    asked = t.supplier.select(k.alias("k"), (k % 90).alias("a"), (k % 13).alias("b"))
    names = t.customer.select(c.alias("id"), (c % 301).alias("na"), (c % 29).alias("nb"))
    a, b = {"a": "na"}, {"b": "nb"}
    return lookup.tiered_match(asked, names, "k", [("exact", a | b), ("first", a), ("second", b)], "id")


@query("N2_relief_position", """SELECT p_partkey, round(CASE WHEN hi > lo THEN greatest(0.0, least(1.0, (e - lo) / (hi - lo))) END, 6) AS position FROM (SELECT p_partkey, p_size::DOUBLE AS e, (p_partkey % 20)::DOUBLE AS lo, (p_partkey % 45)::DOUBLE AS hi FROM part)""")
def n2(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    lo, hi = (k % 20).cast("double"), (k % 45).cast("double")
    return rounded(t.part.select("p_partkey", scalars.relief_position(F.col("p_size").cast("double"), lo, hi).alias("position")))


@query("L5_diameter", f"WITH {PLACED} SELECT round(max({HAV.format(a='a', b='b')}), 4) AS diameter_km FROM p a JOIN p b ON a.unit < b.unit WHERE a.unit % 150 < 40 AND a.v > 8000 AND b.unit % 150 < 40 AND b.v > 8000")
def l5(t: Tables) -> DataFrame:
    return rounded(lenses.diameter_km(placed(t).where("unit % 150 < 40 AND v > 8000"), "lat", "lon"), 4)


@query("B7c_event_rows", """WITH e AS (SELECT event_id, (epoch(ts)::BIGINT // 86400 - 19723)::INTEGER AS d, value FROM events WHERE event_type = 'error'), q AS (SELECT n_nationkey AS k, n_nationkey % 10 AS lo, n_nationkey % 10 + n_nationkey AS hi FROM nation)
SELECT k, event_id, d, value FROM q JOIN e ON d BETWEEN lo AND hi AND d BETWEEN 2 AND 25 AND value >= 80""")
def b7c(t: Tables) -> DataFrame:
    e = t.events.where("event_type = 'error'").select("event_id", day_number("ts", 19723).alias("d"), "value")
    n = F.col("n_nationkey")
    q = t.nation.select(n.alias("k"), (n % 10).alias("lo"), (n % 10 + n).alias("hi"))
    return series.events_in(q, e, "lo", "hi", "d", "value", 80.0, (2, 25)).select("k", "event_id", "d", "value")


@query("G7_across_divide", f"""WITH {PAIRS}, x AS (SELECT n.* FROM n LEFT JOIN c u ON u.node = n.b AND u.ancestor = n.a LEFT JOIN c d ON d.node = n.a AND d.ancestor = n.b WHERE u.node IS NULL AND d.node IS NULL AND ra = rb AND vb IS NOT NULL),
g AS (SELECT a, count(*) AS n, count(*) FILTER (WHERE vb < va) AS n_less, count(*) FILTER (WHERE vb > va) AS n_more FROM x GROUP BY 1)
SELECT *, CASE WHEN n_less >= n_more THEN 'more' ELSE 'less' END AS side, greatest(n_less, n_more) AS k, n_less = n AS top, n_more = n AS bottom, n >= 5 AND greatest(n_less, n_more) = n - 1 AS all_but_one FROM g WHERE n >= 2 AND n_less + n_more > 0""")
def g7(t: Tables) -> DataFrame:
    classed = graph.flow_class(_pairs(t), graph.ancestors(tree(t), "node", "parent"), "a", "b", "ra", "rb")
    return graph.ring_comparison(classed.where("flow = 'same'"), "a", "va", "vb", least=2)


@query("Z12_cluster_labels", """WITH m AS (SELECT c_nationkey % 6 AS cluster, avg(c_acctbal) AS x FROM customer GROUP BY 1), s AS (SELECT c_nationkey % 6 AS cluster, c_mktsegment AS g, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey % 6)::DOUBLE AS share FROM customer GROUP BY 1, 2)
SELECT cluster, CASE WHEN x > 4700 THEN 'high' WHEN x > 4300 THEN 'middle' ELSE 'low' END AS label, min(g) IS NOT NULL AS named, round(max(share), 6) AS top_share FROM m JOIN s USING (cluster) GROUP BY cluster, x""")
def z12(t: Tables) -> DataFrame:
    rows = t.customer.select((F.col("c_nationkey") % 6).alias("cluster"), F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("x"), F.lit(1.0).alias("w"))
    centres = rows.groupBy("cluster").agg(F.avg("x").alias("x"))
    top = weighted.mixture(weighted.shares(rows, ["cluster"], "g", "w"), ["cluster"], "g")
    label = F.when(F.col("x") > 4700, "high").when(F.col("x") > 4300, "middle").otherwise("low")
    return rounded(centres.join(top, "cluster").select("cluster", label.alias("label"), F.col("modal_class").isNotNull().alias("named"), F.col("modal_share").alias("top_share")))


@query("Z13_merged_sources", """WITH a AS (SELECT c_custkey AS k, c_acctbal AS v, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS g FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT s_suppkey * 2 AS k, s_acctbal AS v, 'SUPPLIER' AS g FROM supplier)
SELECT k, coalesce(a.v, b.v) AS v, coalesce(a.g, b.g) AS g, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'first' ELSE 'second' END AS source FROM a FULL JOIN b USING (k)""")
def z13(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    first = t.customer.where(c % 4 != 0).select(c.alias("k"), F.col("c_acctbal").alias("v"), F.when(c % 3 != 0, F.col("c_mktsegment")).alias("g"))
    second = t.supplier.select((F.col("s_suppkey") * 2).alias("k"), F.col("s_acctbal").alias("v"), F.lit("SUPPLIER").alias("g"))
    return lookup.merged_sources(first, second, "k", ["v", "g"])


@query("Z14_stratified_sample", """SELECT c_mktsegment, c_custkey, round(n / least(n, 20)::DOUBLE, 6) AS weight FROM (SELECT c_mktsegment, c_custkey, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey * 7919 % 1009, c_custkey) AS r FROM customer) WHERE r <= 20""")
def z14(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return rounded(lookup.per_stratum(t.customer.select("c_mktsegment", "c_custkey"), "c_mktsegment", [k * 7919 % 1009, k], 20))


SPANS = """sp AS (SELECT n_nationkey AS query_id, n_nationkey * 120 - 800 AS low, n_nationkey * 120 - 800 + n_nationkey % 5 * 150 AS high FROM nation), y0 AS (SELECT unnest(range(0, 1999, 50)) AS y), e0 AS (SELECT unnest(range(-750, 2000, 100)) AS y), v0 AS (SELECT unnest(range(-700, 2000, 70)) AS y),
ya AS (SELECT query_id, 'pdsi' AS variable, y, (y % 37 - 10)::DOUBLE AS v, query_id % 4 AS cells, (y % 11)::DOUBLE AS lo, (y % 11 + query_id)::DOUBLE AS hi FROM sp JOIN y0 ON y BETWEEN low AND high WHERE query_id % 7 <> 0),
ei AS (SELECT query_id, y, 1 AS own FROM sp JOIN e0 ON y BETWEEN low AND high), en AS (SELECT query_id, arg_min(y, [greatest(low - y, y - high), y]) AS y FROM sp, e0 WHERE query_id NOT IN (SELECT query_id FROM ei) AND query_id % 6 <> 5 GROUP BY 1),
ep AS (SELECT query_id, variable, y, (abs(y) % m)::DOUBLE AS v FROM (SELECT query_id, y FROM ei UNION ALL SELECT query_id, y FROM en) JOIN (VALUES ('crop', 53), ('grazing', 41)) u(variable, m) ON true),
ev AS (SELECT query_id, y, (abs(y) % 41)::DOUBLE AS s FROM sp JOIN v0 ON y BETWEEN low AND high WHERE y BETWEEN -491 AND 1890)"""


@query("Y9_statements_over_time", f"""WITH {SPANS}, yn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY y) AS k, count(*) OVER (PARTITION BY query_id) AS nn FROM ya),
m AS (SELECT query_id, avg(v) AS m, count(DISTINCT y) AS n, min(y) AS a, max(y) AS b, max(cells) AS cells, max(hi - lo) FILTER (WHERE k = nn // 2 + 1) AS width FROM yn GROUP BY 1),
c AS (SELECT query_id, variable, count(*) AS n, arg_min(v, y) AS a, arg_max(v, y) AS b FROM ep GROUP BY 1, 2), s AS (SELECT query_id, count(DISTINCT y) AS n, min(y) AS y, sum(v) AS total, bool_or(y = 1950) AS caveat FROM ep GROUP BY 1), t AS (SELECT query_id, max(s) AS top FROM ev GROUP BY 1),
r AS (SELECT query_id, 'BT-01' AS rule, 'pdsi' AS item, CASE WHEN m IS NULL THEN 'no_yearly_rows' END AS reason, m AS stat FROM sp LEFT JOIN m USING (query_id)
UNION ALL SELECT query_id, 'BT-02', 'pdsi', CASE WHEN m IS NULL THEN 'no_yearly_rows' WHEN cells < 2 THEN 'one_cell' END, width FROM sp LEFT JOIN m USING (query_id)
UNION ALL SELECT query_id, 'BT-03', '(query)', CASE WHEN m IS NULL THEN 'no_yearly_rows' END, cells FROM sp LEFT JOIN m USING (query_id)
UNION ALL SELECT query_id, 'BT-04', '(query)', CASE WHEN n IS NULL THEN CASE WHEN NOT (high < 0 OR low > 1998) THEN 'no_rows_inside_record' END WHEN NOT (a > low OR b < high) THEN 'fully_covered' END, coalesce(n / (high - low + 1)::DOUBLE, 0) FROM sp LEFT JOIN m USING (query_id)
UNION ALL SELECT query_id, 'BT-05', '(query)', CASE WHEN n IS NULL THEN 'no_epoch_rows' WHEN n > 1 THEN 'several_epochs' END, total FROM sp LEFT JOIN s USING (query_id)
UNION ALL SELECT sp.query_id, 'BT-06', u.variable, CASE WHEN s.n IS NULL THEN 'no_epoch_rows' WHEN coalesce(c.n, 0) < 2 THEN 'single_epoch' END, CASE WHEN c.a > 0 THEN (c.b - c.a) / c.a END FROM sp JOIN (VALUES ('crop'), ('grazing')) u(variable) ON true LEFT JOIN s ON s.query_id = sp.query_id LEFT JOIN c ON c.query_id = sp.query_id AND c.variable = u.variable
UNION ALL SELECT query_id, 'BT-07', '(query)', CASE WHEN n IS NULL THEN 'no_epoch_rows' WHEN y BETWEEN low AND high THEN 'epoch_inside_span' END, greatest(low - y, y - high) FROM sp LEFT JOIN s USING (query_id)
UNION ALL SELECT query_id, 'BT-08', '(query)', CASE WHEN n IS NULL THEN 'no_epoch_rows' WHEN NOT caveat THEN 'no_caveat' END, NULL FROM sp LEFT JOIN s USING (query_id)
UNION ALL SELECT query_id, 'BT-09', '(query)', CASE WHEN top IS NULL THEN 'no_events' END, top FROM sp LEFT JOIN t USING (query_id) UNION ALL SELECT query_id, 'BT-10', '(query)', CASE WHEN top IS NOT NULL THEN 'events_present' END, 0 FROM sp LEFT JOIN t USING (query_id))
SELECT query_id, rule, item, reason IS NULL AS applies, reason, CASE WHEN reason IS NULL THEN round(stat, 6) END AS stat FROM r""")
def y9(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    spans = t.nation.select(k.alias("query_id"), (k * 120 - 800).alias("low"), (k * 120 - 800 + k % 5 * 150).alias("high"))
    inside = lambda first, last, step: spans.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step)))).where(F.col("year").between(F.col("low"), F.col("high")))
    y, q = F.col("year"), F.col("query_id")
    cells = ((q % 4).alias("n_cells"), (y % 11).cast("double").alias("least"), (y % 11 + q).cast("double").alias("most"))
    yearly = inside(0, 1998, 50).where("query_id % 7 <> 0").select("query_id", F.lit("pdsi").alias("variable"), "year", (y % 37 - 10).cast("double").alias("value"), *cells)
    own = inside(-750, 1999, 100)
    steps = F.sequence(F.lit(-750), F.lit(1999), F.lit(100))
    nearest = F.array_min(F.transform(steps, lambda e: F.struct(F.greatest(F.col("low") - e, e - F.col("high")).alias("d"), e.alias("year"))))["year"]
    other = spans.join(own.select("query_id").distinct(), "query_id", "left_anti").where("query_id % 6 <> 5").withColumn("year", nearest)
    uses = F.inline(F.array(*(F.struct(F.lit(n).alias("variable"), (F.abs(y) % m).cast("double").alias("value")) for n, m in (("crop", 53), ("grazing", 41)))))
    epochs = own.unionByName(other).select("query_id", "year", uses)
    events = inside(-700, 1999, 70).where(y.between(*statements.EVENTS)).select("query_id", "year", (F.abs(y) % 41).cast("double").alias("size"))
    return rounded(statements.over_time(spans, yearly, epochs, events, ["pdsi"], ["crop", "grazing"]))
