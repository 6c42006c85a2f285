"""Monthly curves of suppliers, lenses over customers and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import curves, scalars
from terrane.operators import lenses, position
from terrane.plans.registry import Tables, query, rounded

MONTHS = """m AS (SELECT l_suppkey AS cell, month(l_shipdate) AS mo, sum(l_quantity) AS q, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY 1, 2),
k AS (SELECT cell, (mo - 1)::INTEGER AS t, q, r FROM m)"""


def monthly(t: Tables) -> DataFrame:
    """(cell, q, r): two twelve-month curves, whole for every supplier with lines in all months."""
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("cell"), F.month("l_shipdate").alias("mo")).agg(F.sum("l_quantity").alias("q"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("r"))
    whole = per.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("mo", "q", "r"))).alias("a"))
    return whole.where(F.size("a") == 12).select("cell", F.transform("a", lambda x: x["q"]).alias("q"), F.transform("a", lambda x: x["r"]).alias("r"))


WHOLE = " HAVING count(*) = 12"


@query("H1_harmonics", f"WITH {MONTHS} SELECT cell, round(sum(q * cos(2 * pi() * t / 12)) / sum(q), 6) AS a1, round(sum(q * sin(2 * pi() * t / 12)) / sum(q), 6) AS b1, round(sum(q * cos(4 * pi() * t / 12)) / sum(q), 6) AS a2, round(sum(q * sin(4 * pi() * t / 12)) / sum(q), 6) AS b2, round(ln(1 + sum(q)), 6) AS log_total FROM k GROUP BY 1{WHOLE}")
def h1(t: Tables) -> DataFrame:
    return rounded(monthly(t).select("cell", curves.harmonics(F.col("q")).alias("h")).select("cell", "h.*"))


@query("N3_circular_concentration", f"""WITH {MONTHS}, c AS (SELECT cell, sum(q * cos(2 * pi() * t / 12)) AS x, sum(q * sin(2 * pi() * t / 12)) AS y, sum(q) AS s FROM k GROUP BY 1{WHOLE})
SELECT cell, round(sqrt(x * x + y * y) / s, 6) AS concentration, round((atan2(y, x) / (2 * pi()) * 12 + 12) % 12, 6) AS peak FROM c""")
def n3(t: Tables) -> DataFrame:
    return rounded(monthly(t).select("cell", curves.concentration(F.col("q")).alias("concentration"), curves.peak_month(F.col("q")).alias("peak")))


@query("N4_seasonality_indices", f"""WITH {MONTHS}, c AS (SELECT cell, sum(q * cos(2 * pi() * t / 12)) AS x, sum(q * sin(2 * pi() * t / 12)) AS y, sum(r * cos(2 * pi() * t / 12)) AS u, sum(r * sin(2 * pi() * t / 12)) AS v, max(q) - min(q) AS amplitude, stddev_pop(q) / avg(q) AS cv FROM k GROUP BY 1{WHOLE}),
p AS (SELECT *, abs((atan2(y, x) / (2 * pi()) * 12 + 12) % 12 - (atan2(v, u) / (2 * pi()) * 12 + 12) % 12) AS d FROM c) SELECT cell, round(amplitude, 6) AS amplitude, round(cv, 6) AS cv, round(least(d, 12 - d), 6) AS phase_offset FROM p""")
def n4(t: Tables) -> DataFrame:
    q, r = F.col("q"), F.col("r")
    return rounded(monthly(t).select("cell", (F.array_max(q) - F.array_min(q)).alias("amplitude"), curves.cv(q).alias("cv"), curves.phase_offset(q, r).alias("phase_offset")))


@query("H3_curve_correlation", f"""WITH {MONTHS}, w AS (SELECT * FROM k WHERE cell IN (SELECT cell FROM k GROUP BY 1{WHOLE})) SELECT b.cell, round(corr(a.q, b.q), 6) AS r, round(sqrt(greatest(0, 2 * (1 - corr(a.q, b.q)))), 6) AS chord FROM w a JOIN w b USING (t) WHERE a.cell = 1 GROUP BY 1""")
def h3(t: Tables) -> DataFrame:
    unit = monthly(t).select("cell", curves.centred_unit(F.col("q")).alias("u"))
    one = F.broadcast(unit.where("cell = 1").select(F.col("u").alias("v")))
    r = curves.dot(F.col("u"), F.col("v"))
    return rounded(unit.join(one).select("cell", r.alias("r"), curves.chord(F.round(r, 15)).alias("chord"))).withColumn("chord", F.when(F.col("cell") == 1, 0.0).otherwise(F.col("chord")))


@query("H4_rowwise_pearson", f"WITH {MONTHS} SELECT cell, round(corr(q, r), 6) AS r, round(stddev_pop(q) / avg(q), 6) AS cv FROM k GROUP BY 1{WHOLE}")
def h4(t: Tables) -> DataFrame:
    return rounded(monthly(t).select("cell", curves.pearson(F.col("q"), F.col("r")).alias("r"), curves.cv(F.col("q")).alias("cv")))


@query("H8_doubled_angle", f"WITH {MONTHS}, c AS (SELECT cell, sqrt(sum(q * cos(4 * pi() * t / 12)) ** 2 + sum(q * sin(4 * pi() * t / 12)) ** 2) / sum(q) AS d FROM k GROUP BY 1{WHOLE}) SELECT cell, round(d, 6) AS r_dbl, CASE WHEN d >= 0.4 THEN 'bimodal' WHEN d >= 0.03 THEN 'mixed' ELSE 'uniform' END AS regime FROM c")
def h8(t: Tables) -> DataFrame:
    d = curves.concentration(F.col("q"), k=2)
    return rounded(monthly(t).select("cell", d.alias("r_dbl"), F.when(d >= 0.4, "bimodal").when(d >= 0.03, "mixed").otherwise("uniform").alias("regime")))


@query("H9_two_harmonic_reconstruction", f"""WITH {MONTHS}, c AS (SELECT cell, avg(q) AS m, sum(q * cos(2 * pi() * t / 12)) / 6 AS c1, sum(q * sin(2 * pi() * t / 12)) / 6 AS s1, sum(q * cos(4 * pi() * t / 12)) / 6 AS c2, sum(q * sin(4 * pi() * t / 12)) / 6 AS s2 FROM k GROUP BY 1{WHOLE})
SELECT cell, x::INTEGER AS month, round(greatest(0, m + c1 * cos(2 * pi() * x / 12) + s1 * sin(2 * pi() * x / 12) + c2 * cos(4 * pi() * x / 12) + s2 * sin(4 * pi() * x / 12)), 5) AS v FROM c, (SELECT unnest(range(0, 12)) AS x)""")
def h9(t: Tables) -> DataFrame:
    return monthly(t).select("cell", F.posexplode(curves.reconstruction(F.col("q"))).alias("month", "v")).withColumn("v", F.round("v", 5))


@query("H10_best_shift", f"""WITH {MONTHS}, w AS (SELECT * FROM k WHERE cell IN (SELECT cell FROM k GROUP BY 1{WHOLE})), s AS (SELECT b.cell, x AS shift, corr(a.q, b.q) AS r FROM w a, (SELECT unnest(range(0, 12)) AS x), w b WHERE a.cell = 1 AND b.t = (a.t + x) % 12 GROUP BY 1, 2)
SELECT cell, arg_max(shift, [round(r, 9), -shift])::INTEGER AS shift, round(max(r), 6) AS r FROM s GROUP BY 1""")
def h10(t: Tables) -> DataFrame:
    m = monthly(t)
    one = F.broadcast(m.where("cell = 1").select(F.col("q").alias("o")))
    turned = m.join(one).select("cell", "o", "q", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("shift"))
    scored = turned.select("cell", "shift", curves.pearson(F.col("o"), curves.shifted(F.col("q"), F.col("shift"))).alias("r"))
    return rounded(scored.groupBy("cell").agg(F.max_by("shift", F.struct(F.round("r", 9), -F.col("shift"))).alias("shift"), F.max("r").alias("r")))


@query("H6_two_period_fit", None)
def h6(t: Tables) -> DataFrame:
    fit = monthly(t).select("cell", "q", "r", lenses.two_period_fit("q").alias("f"))
    total = curves.total(F.col("q"))
    return rounded(fit.select("cell", F.col("f.e12").alias("e12"), F.col("f.e6").alias("e6"), lenses.modality_class(F.col("q"), total, F.col("f.e12"), F.col("f.e6")).alias("modality"), lenses.phase_class(F.col("q"), F.col("r"), F.array_max("q") - F.array_min("q")).alias("phase")))


@query("L8_phase_class", f"""WITH {MONTHS}, c AS (SELECT cell, corr(q, r) AS r, max(q) - min(q) AS a FROM k GROUP BY 1{WHOLE}), p AS (SELECT CASE WHEN a < 5 THEN 'no thermal cycle' WHEN r >= 0.5 THEN 'warm-wet' WHEN r <= -0.5 THEN 'cool-wet' ELSE 'weak' END AS phase FROM c) SELECT phase, count(*) AS n FROM p GROUP BY 1""")
def l8(t: Tables) -> DataFrame:
    q = F.col("q")
    return monthly(t).groupBy(lenses.phase_class(q, F.col("r"), F.array_max(q) - F.array_min(q)).alias("phase")).agg(F.count("*").alias("n"))


FEATURES = ["x", "y", "z"]
SPACE = "f AS (SELECT c_custkey AS unit, c_acctbal AS x, count(o_orderkey)::DOUBLE AS y, avg(o_totalprice) AS z FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), w AS (SELECT * FROM f WHERE z IS NOT NULL)"


def space(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("unit")).agg(F.count("*").cast("double").alias("y"), F.avg("o_totalprice").alias("z"))
    return t.customer.select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("x")).join(per, "unit", "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


def _asked(t: Tables) -> DataFrame:
    return space(t).where("z IS NOT NULL AND unit % 50 = 1").select(F.col("unit").alias("query_id"))


@query("L1_zscore_lens", f"""WITH {SPACE}, s AS (SELECT avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy, avg(z) mz, stddev_pop(z) sz FROM w), n AS (SELECT unit, (x - mx) / sx AS x, (y - my) / sy AS y, (z - mz) / sz AS z FROM w, s),
d AS (SELECT q.unit AS query_id, n.unit, sqrt((n.x - q.x) ** 2 + (n.y - q.y) ** 2 + (n.z - q.z) ** 2) AS d FROM n q JOIN n ON q.unit <> n.unit WHERE q.unit % 50 = 1) SELECT query_id, unit, round(d, 6) AS distance FROM d WHERE d <= 0.6""")
def l1(t: Tables) -> DataFrame:
    return rounded(lenses.within(lenses.euclidean(space(t), _asked(t), FEATURES, "unit"), lenses.RADII["precip"]["moderate"], None, "unit"))


@query("L2_mahalanobis_lens", f"""WITH {SPACE}, s AS (SELECT covar_samp(x, x) a, covar_samp(x, y) b, covar_samp(x, z) c, covar_samp(y, y) e, covar_samp(y, z) f, covar_samp(z, z) i FROM w),
v AS (SELECT *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) AS det FROM s), g AS (SELECT (e * i - f * f) / det AS xx, (c * f - b * i) / det AS xy, (b * f - c * e) / det AS xz, (a * i - c * c) / det AS yy, (b * c - a * f) / det AS yz, (a * e - b * b) / det AS zz FROM v),
d AS (SELECT q.unit AS query_id, n.unit, n.x - q.x AS x, n.y - q.y AS y, n.z - q.z AS z FROM w q JOIN w n ON q.unit <> n.unit WHERE q.unit % 50 = 1),
m AS (SELECT query_id, unit, sqrt(greatest(0, x * x * xx + 2 * x * y * xy + 2 * x * z * xz + y * y * yy + 2 * y * z * yz + z * z * zz)) AS d FROM d, g)
SELECT query_id, unit, round(d, 4) AS distance, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, unit) AS r FROM m) WHERE r <= 5""")
def l2(t: Tables) -> DataFrame:
    return rounded(lenses.mahalanobis_nearest(space(t), _asked(t), FEATURES, "unit", 5), 4)


CONJ = ["ratio", "level", "band"]


def _conjunction(t: Tables) -> DataFrame:
    s = space(t)
    one = s.where("unit = 1").select(*(F.col(c).alias(f"q_{c}") for c in ("unit", *FEATURES)))
    one = one.withColumn("q_y", F.coalesce("q_y", F.lit(0.0)))
    c = [("ratio", F.col("z").between(F.col("q_z") / 1.5, F.col("q_z") * 1.5)), ("level", F.abs(F.col("x") - F.col("q_x")) <= 3000), ("band", F.abs(F.col("y") - F.col("q_y")) <= 4)]
    return lenses.conjunction(s, one, c, "unit")


CJ = f"WITH {SPACE}, q AS (SELECT * FROM f WHERE unit = 1), j AS (SELECT f.unit, coalesce(f.z BETWEEN q.z / 1.5 AND q.z * 1.5, false) AS ratio, coalesce(abs(f.x - q.x) <= 3000, false) AS level, coalesce(abs(f.y - q.y) <= 4, false) AS band FROM f, q)"


@query("L4_conjunction_lens", CJ + " SELECT unit, ratio, level, band, ratio AND level AND band AND unit <> 1 AS member FROM j")
def l4(t: Tables) -> DataFrame:
    return _conjunction(t)


@query("L4_attrition", CJ + " SELECT 'ratio' AS condition, 0 AS position, count(*) FILTER (WHERE ratio) AS n_alone, count(*) FILTER (WHERE ratio) AS n_left FROM j UNION ALL SELECT 'level', 1, count(*) FILTER (WHERE level), count(*) FILTER (WHERE ratio AND level) FROM j UNION ALL SELECT 'band', 2, count(*) FILTER (WHERE band), count(*) FILTER (WHERE ratio AND level AND band) FROM j")
def l4a(t: Tables) -> DataFrame:
    return lenses.attrition(_conjunction(t), CONJ)


PLACED = "p AS (SELECT c_custkey AS unit, (c_custkey % 180 - 90)::DOUBLE AS lat, (c_nationkey * 14 - 175)::DOUBLE AS lon, c_acctbal AS v FROM customer)"
HAV = "2 * 6371.0088 * asin(sqrt(greatest(0, least(1, sin(radians(({b}.lat - {a}.lat)) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ** 2))))"


def placed(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("unit"), (F.col("c_custkey") % 180 - 90).cast("double").alias("lat"), (F.col("c_nationkey") * 14 - 175).cast("double").alias("lon"), F.col("c_acctbal").alias("v"))


@query("R9_haversine_bearing", f"WITH {PLACED} SELECT a.unit, round({HAV.format(a='a', b='o')}, 4) AS km, round((degrees(atan2(sin(radians(o.lon - a.lon)) * cos(radians(o.lat)), cos(radians(a.lat)) * sin(radians(o.lat)) - sin(radians(a.lat)) * cos(radians(o.lat)) * cos(radians(o.lon - a.lon)))) + 360) % 360, 4) AS bearing FROM p a, (SELECT lat, lon FROM p WHERE unit = 7) o WHERE a.unit <> 7")
def r9(t: Tables) -> DataFrame:
    p = placed(t)
    o = F.broadcast(p.where("unit = 7").select(F.col("lat").alias("la"), F.col("lon").alias("lo")))
    args = [F.col(c) for c in ("lat", "lon", "la", "lo")]
    return rounded(p.where("unit <> 7").join(o).select("unit", scalars.haversine_km(*args).alias("km"), scalars.bearing(*args).alias("bearing")), 4)


@query("L11_context_percentiles", f"""WITH {PLACED}, g AS (SELECT unit, 100 * (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 - 1) / (count(*) OVER () - 1) AS pct FROM p),
n AS (SELECT a.unit, a.v, 100 * (rank() OVER (ORDER BY a.v) + (count(*) OVER (PARTITION BY a.v) - 1) / 2.0 - 1) / (count(*) OVER () - 1) AS pct FROM p a, (SELECT lat, lon FROM p WHERE unit = 7) o WHERE {HAV.format(a='a', b='o')} <= 3000)
SELECT n.unit, round(n.v, 4) AS v, round(g.pct, 6) AS global_pct, round(n.pct, 6) AS near_pct FROM n JOIN g USING (unit)""")
def l11(t: Tables) -> DataFrame:
    p = placed(t)
    o = F.broadcast(p.where("unit = 7").select(F.col("lat").alias("la"), F.col("lon").alias("lo")))
    ranked = position.average_rank(p, "v", out="global_pct")
    near = ranked.join(o).where(scalars.haversine_km(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")) <= 3000)
    return rounded(position.average_rank(near.select("unit", "v", "global_pct"), "v", out="near_pct"))


@query("L12_terrain_tolerance", """WITH d AS (SELECT p_partkey AS unit, p_retailprice AS elevation, p_size * 10.0 AS relief, (p_partkey % 100) / 100.0 AS position FROM part),
n AS (SELECT d.unit, sqrt(((d.elevation - q.elevation) / 300) ** 2 + ((d.relief - q.relief) / 200) ** 2 + ((d.position - q.position) / 0.1) ** 2) AS x FROM d, (SELECT * FROM d WHERE unit = 50) q WHERE d.unit <> 50 AND abs(d.elevation - q.elevation) <= 300 AND abs(d.relief - q.relief) <= 200 AND abs(d.position - q.position) <= 0.1)
SELECT unit, round(x, 6) AS distance, (row_number() OVER (ORDER BY x, unit))::INTEGER AS rank FROM n""")
def l12(t: Tables) -> DataFrame:
    d = t.part.select(F.col("p_partkey").alias("unit"), F.col("p_retailprice").alias("elevation"), (F.col("p_size") * 10.0).alias("relief"), ((F.col("p_partkey") % 100) / 100.0).alias("position"))
    return rounded(lenses.terrain_rank(d, d.where("unit = 50"), "unit"))


V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings)"


@query("L14_vector_knn", f"WITH {V}, d AS (SELECT v.vec_id, list_distance(v.e, q.e) AS d FROM v, (SELECT e FROM v WHERE vec_id = 3) q WHERE v.vec_id <> 3) SELECT vec_id, round(d, 6) AS distance FROM d ORDER BY d, vec_id LIMIT 25")
def l14(t: Tables) -> DataFrame:
    q = F.broadcast(t.embeddings.where("vec_id = 3").select(F.col("embedding").alias("q")))
    near = t.embeddings.where("vec_id <> 3").join(q).select("vec_id", lenses.vector_distance(F.col("embedding"), F.col("q")).alias("distance"))
    return rounded(near.orderBy("distance", "vec_id").limit(25))


@query("L14_distance_ranks", f"WITH {V}, d AS (SELECT v.vec_id, round(list_distance(v.e, q.e), 9) AS d FROM v, (SELECT e FROM v WHERE vec_id = 3) q WHERE v.vec_id <> 3) SELECT vec_id, round(d, 6) AS distance, round(100 * percent_rank() OVER (ORDER BY d), 6) AS score FROM d")
def l14r(t: Tables) -> DataFrame:
    return rounded(position.percent_rank(_from_three(t), "distance"))


@query("L14_distance_quartiles", f"WITH {V}, d AS (SELECT round(list_distance(v.e, q.e), 9) AS d FROM v, (SELECT e FROM v WHERE vec_id = 3) q WHERE v.vec_id <> 3) SELECT count(*) AS n, round(min(d), 6) AS least, round(quantile_cont(d, 0.25), 6) AS q1, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS q3, round(max(d), 6) AS most FROM d")
def l14q(t: Tables) -> DataFrame:
    d = F.col("distance")
    return rounded(_from_three(t).agg(F.count("*").alias("n"), F.min(d).alias("least"), *(F.percentile(d, q).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))), F.max(d).alias("most")))


def _from_three(t: Tables) -> DataFrame:
    q = F.broadcast(t.embeddings.where("vec_id = 3").select(F.col("embedding").alias("q")))
    return t.embeddings.where("vec_id <> 3").join(q).select("vec_id", F.round(lenses.vector_distance(F.col("embedding"), F.col("q")), 9).alias("distance"))


@query("L19_cosine_rank", f"WITH {V}, d AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.e, q.e) AS s FROM v, v q WHERE v.vec_id <> q.vec_id AND q.vec_id IN (3, 44, 101)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM d) SELECT query_id, vec_id, round(s, 6) AS similarity, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def l19(t: Tables) -> DataFrame:
    q = F.broadcast(t.embeddings.where("vec_id IN (3, 44, 101)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))
    near = t.embeddings.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", lenses.cosine(F.col("embedding"), F.col("q")).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return rounded(near.withColumn("rank", F.row_number().over(w)).where("rank <= 10"))


@query("L15_minmax_onehot", "SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 6) AS size_norm, (p_type = (SELECT min(p_type) FROM part))::INTEGER AS first_type FROM part")
def l15(t: Tables) -> DataFrame:
    ends = F.broadcast(t.part.agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.min("p_type").alias("ty")))
    return rounded(t.part.join(ends).select("p_partkey", F.try_divide((F.col("p_size") - F.col("lo")).cast("double"), F.col("hi") - F.col("lo")).alias("size_norm"), (F.col("p_type") == F.col("ty")).cast("int").alias("first_type")))


@query("L27_divergence", "SELECT c_custkey, round(100 * (s_acctbal - c_acctbal) / ((abs(c_acctbal) + abs(s_acctbal)) / 2), 4) AS pct FROM customer JOIN (SELECT s_nationkey, max(s_acctbal) AS s_acctbal FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey")
def l27(t: Tables) -> DataFrame:
    s = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("s_acctbal"))
    return rounded(t.customer.join(s, "c_nationkey").select("c_custkey", scalars.divergence(F.col("c_acctbal"), F.col("s_acctbal")).alias("pct")), 4)
