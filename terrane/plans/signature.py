"""Areal signatures: nations are queries, customers the units, a customer's share of its nation's order value the weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import blocks, dispersion, position, weighted
from terrane.plans.registry import Tables, money, query, rounded

VARIABLES = ["acctbal", "surplus", "n_orders"]


def weights(t: Tables) -> DataFrame:
    """(query_id, unit_id, weight): the share of a customer in the order value of its nation."""
    spent = t.orders.groupBy(F.col("o_custkey").alias("unit_id")).agg(F.sum(money("o_totalprice")).alias("spent"))
    placed = spent.join(t.customer.select(F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("query_id")), "unit_id")
    share = F.col("spent").cast("double") / F.sum("spent").over(Window.partitionBy("query_id")).cast("double")
    return placed.select("query_id", "unit_id", share.alias("weight"))


def variables(t: Tables) -> DataFrame:
    """Units with their variables; every 17th unit has no data for the first."""
    orders = t.orders.groupBy(F.col("o_custkey").alias("unit_id")).agg(F.count("*").cast("double").alias("n_orders"))
    units = t.customer.select(
        F.col("c_custkey").alias("unit_id"),
        F.when(F.col("c_custkey") % 17 != 0, F.col("c_acctbal")).alias("acctbal"),
        F.greatest(F.col("c_acctbal") - 5000, F.lit(0.0)).alias("surplus"),
        F.col("c_mktsegment").alias("segment"),
    )
    return units.join(orders, "unit_id", "left")


def rows(t: Tables) -> DataFrame:
    """(query_id, unit_id, variable, weight, score, raw): every variable of every unit of every query."""
    scores = position.scores_long(variables(t), "unit_id", VARIABLES)
    return weights(t).join(scores, "unit_id").select("query_id", "unit_id", "variable", "weight", "score", "raw")


W = """
w AS (SELECT c_nationkey AS query_id, c_custkey AS unit_id, sum(o_totalprice::DECIMAL(18,2)) AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
ws AS (SELECT query_id, unit_id, spent::DOUBLE / (sum(spent) OVER (PARTITION BY query_id))::DOUBLE AS weight FROM w),
no AS (SELECT o_custkey AS unit_id, count(*)::DOUBLE AS n_orders FROM orders GROUP BY 1),
va AS (SELECT c_custkey AS unit_id, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS acctbal, greatest(c_acctbal - 5000, 0.0) AS surplus, n_orders, c_mktsegment AS segment
       FROM customer LEFT JOIN no ON c_custkey = no.unit_id),
lo AS (SELECT unit_id, 'acctbal' AS variable, acctbal AS raw FROM va UNION ALL SELECT unit_id, 'surplus', surplus FROM va UNION ALL SELECT unit_id, 'n_orders', n_orders FROM va),
sc AS (SELECT unit_id, variable, raw, 100 * percent_rank() OVER (PARTITION BY variable ORDER BY raw) AS score FROM lo WHERE raw IS NOT NULL
       UNION ALL SELECT unit_id, variable, NULL, NULL FROM lo WHERE raw IS NULL),
r AS (SELECT query_id, unit_id, variable, weight, score, raw FROM ws JOIN sc USING (unit_id))"""

CUM = """,
c0 AS (SELECT *, weight / sum(weight) OVER (PARTITION BY query_id, variable) AS sh FROM r WHERE score IS NOT NULL AND weight > 0),
c1 AS (SELECT *, sum(sh) OVER (PARTITION BY query_id, variable ORDER BY score, unit_id ROWS UNBOUNDED PRECEDING) AS cum FROM c0),
c AS (SELECT *, lead(score) OVER (PARTITION BY query_id, variable ORDER BY score, unit_id) AS ns, lead(cum) OVER (PARTITION BY query_id, variable ORDER BY score, unit_id) AS nc FROM c1)"""


def _q(q: float, name: str, at: str = "cum", nxt: str = "nc") -> str:
    return f"coalesce(CASE WHEN min({at}) >= {q} THEN min(score) END, max(CASE WHEN {at} <= {q} AND {nxt} > {q} THEN score + (ns - score) * ({q} - {at}) / ({nxt} - {at}) END), max(score)) AS {name}"


QS = """,
q AS (SELECT query_id, variable, """ + ", ".join(_q(x, n) for n, x in (("p10", 0.1), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9))) + """ FROM c GROUP BY 1, 2),
b AS (SELECT query_id, variable, sum(CASE WHEN score IS NOT NULL THEN weight ELSE 0 END) AS coverage, sum(weight * score) / sum(CASE WHEN score IS NOT NULL THEN weight END) AS mean,
      sum(CASE WHEN score = 0 THEN weight ELSE 0 END) AS weight_at_zero FROM r GROUP BY 1, 2)"""

CORE = """,
win AS (SELECT query_id, variable, lo, round(sum(sh), 12) AS s FROM c, (SELECT unnest(range(0, 71)) AS lo) WHERE score BETWEEN lo AND lo + 30 GROUP BY 1, 2, 3),
core AS (SELECT query_id, variable, max(s) AS core_share, arg_min(lo, [-s, lo]) AS window_lo FROM win GROUP BY 1, 2),
tie AS (SELECT query_id, variable, max(w) AS tie, sum(n)::BIGINT AS n_units FROM (SELECT query_id, variable, score, sum(sh) AS w, count(*) AS n FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN n_units >= 5 THEN CASE WHEN tie >= 0.5 AND 1 - core_share >= 0.1 THEN 'split' WHEN core_share >= 0.65 THEN 'concentrated' ELSE 'spread' END END AS coherence
      FROM core JOIN tie USING (query_id, variable))"""

ZF = ",\nzf AS (SELECT variable, avg((raw = 0)::INT) AS zero_fraction FROM lo WHERE raw IS NOT NULL GROUP BY 1)"


def signature(t: Tables) -> DataFrame:
    zeros = position.neutral_long(variables(t), "unit_id", VARIABLES).groupBy("variable").agg(weighted.zero_fraction("raw").alias("zero_fraction"))
    return blocks.area_weighted(rows(t).join(F.broadcast(zeros), "variable"), zero_fraction="zero_fraction")


@query("B1_area_weighted", "WITH " + W + CUM + QS + CORE + ZF + """
SELECT query_id, variable, 'area_weighted' AS method, st AS status, n_units, round(coverage, 6) AS coverage, CASE WHEN st = 'ok' THEN round(mean, 6) END AS representative_score,
       round(p10, 6) AS p10, round(p25, 6) AS p25, round(p75, 6) AS p75, round(p90, 6) AS p90, round(p90 - p10, 6) AS spread, round(p75 - p25, 6) AS iqr, round(weight_at_zero, 6) AS weight_at_zero,
       round(core_share, 6) AS core_share, window_lo::INTEGER AS window_lo, (window_lo + 30)::INTEGER AS window_hi, CASE WHEN st = 'ok' THEN coherence END AS coherence
FROM (SELECT *, CASE WHEN coverage < 1e-9 THEN 'no_data' WHEN zero_fraction >= 0.2 AND weight_at_zero >= 0.9 THEN 'outside_active_domain' ELSE 'ok' END AS st FROM b JOIN q USING (query_id, variable) JOIN d USING (query_id, variable) JOIN zf USING (variable))""")
def b1(t: Tables) -> DataFrame:
    return rounded(signature(t))


@query("B5_distribution_only", "WITH " + W + CUM + QS + CORE + """
SELECT query_id, variable, 'distribution_only' AS method, 'ok' AS status, n_units, round(coverage, 6) AS coverage, round(mean, 6) AS representative_score,
       round(p10, 6) AS p10, round(p90, 6) AS p90, coherence FROM b JOIN q USING (query_id, variable) JOIN d USING (query_id, variable)""")
def b5(t: Tables) -> DataFrame:
    return rounded(blocks.distribution_only(rows(t)).select("query_id", "variable", "method", "status", "n_units", "coverage", "representative_score", "p10", "p90", "coherence"))


@query("A11_weighted_mean_coverage", "WITH " + W + """
SELECT query_id, variable, count(*) AS n_units, round(sum(weight * score) / sum(CASE WHEN score IS NOT NULL THEN weight END), 6) AS wmean,
       round(sum(CASE WHEN score IS NOT NULL THEN weight ELSE 0 END), 6) AS coverage,
       round(greatest(0, round(1 - sum(CASE WHEN score IS NOT NULL THEN weight ELSE 0 END), 6)), 6) AS shortfall,
       round(sum(CASE WHEN weight < 0.02 THEN weight ELSE 0 END), 6) AS marginal FROM r GROUP BY 1, 2""")
def a11(t: Tables) -> DataFrame:
    held = weighted.coverage("score", "weight")
    return rounded(rows(t).groupBy("query_id", "variable").agg(
        F.count("*").alias("n_units"), weighted.wmean("score", "weight").alias("wmean"), held.alias("coverage"),
        F.greatest(F.lit(0.0), F.round(1 - held, 6)).alias("shortfall"), F.sum(F.when(F.col("weight") < 0.02, F.col("weight")).otherwise(0.0)).alias("marginal")))


@query("A14_weighted_quantile", "WITH " + W + CUM + """
SELECT query_id, variable, """ + ", ".join(f"round({_q(x, 'x').removesuffix(' AS x')}, 6) AS {n}" for n, x in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))) + " FROM c GROUP BY 1, 2")
def a14(t: Tables) -> DataFrame:
    keys = ["query_id", "variable"]
    return rounded(weighted.quantiles(weighted.cumulated(rows(t), keys, "unit_id", "score", "weight"), keys, "score", {"p05": 0.05, "p50": 0.5, "p95": 0.95}))


@query("A15_midpoint_quantile", "WITH " + W + CUM + """,
m AS (SELECT *, cum - sh / 2 AS mid FROM c), m2 AS (SELECT *, lead(mid) OVER (PARTITION BY query_id, variable ORDER BY cum, mid) AS nm FROM m)
SELECT query_id, variable, """ + ", ".join(f"round({_q(x, 'x', 'mid', 'nm').removesuffix(' AS x')}, 6) AS {n}" for n, x in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))) + " FROM m2 GROUP BY 1, 2")
def a15(t: Tables) -> DataFrame:
    keys = ["query_id", "variable"]
    return rounded(weighted.midpoint_quantiles(weighted.cumulated(rows(t), keys, "unit_id", "score", "weight"), keys, "score", {"p25": 0.25, "p50": 0.5, "p75": 0.75}))


@query("A13_weighted_sd", "WITH " + W + """,
m AS (SELECT *, sum(weight * score) OVER (PARTITION BY query_id, variable) / sum(weight) OVER (PARTITION BY query_id, variable) AS mu FROM r WHERE score IS NOT NULL)
SELECT query_id, variable, round(max(mu), 6) AS mean, round(sqrt(sum(weight * (score - mu) ** 2) / sum(weight)), 6) AS sd, round(sum(weight) ** 2 / sum(weight * weight), 6) AS w_eff FROM m GROUP BY 1, 2""")
def a13(t: Tables) -> DataFrame:
    return rounded(weighted.wsd(rows(t), ["query_id", "variable"], "score", "weight"))


@query("A16_weighted_histogram", "WITH " + W + """,
h0 AS (SELECT *, min(score) OVER (PARTITION BY query_id, variable) AS mn, max(score) OVER (PARTITION BY query_id, variable) AS mx, weight / sum(weight) OVER (PARTITION BY query_id, variable) AS sh FROM r WHERE score IS NOT NULL),
h AS (SELECT *, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM h0),
s AS (SELECT query_id, variable, lo, hi, least(19, floor((score - lo) / (hi - lo) * 20))::INTEGER AS bin, sum(sh) AS weight FROM h GROUP BY 1, 2, 3, 4, 5),
f AS (SELECT DISTINCT query_id, variable, lo, hi, bin FROM s, (SELECT unnest(range(0, 20))::INTEGER AS b2) x, LATERAL (SELECT b2 AS bin2)),
g AS (SELECT query_id, variable, lo, hi, b.bin FROM (SELECT DISTINCT query_id, variable, lo, hi FROM s) k, (SELECT unnest(range(0, 20))::INTEGER AS bin) b)
SELECT g.query_id, g.variable, round(g.lo, 6) AS lo, round(g.hi, 6) AS hi, g.bin, round(coalesce(s.weight, 0), 6) AS weight FROM g LEFT JOIN s USING (query_id, variable, lo, hi, bin)""".replace("f AS (SELECT DISTINCT query_id, variable, lo, hi, bin FROM s, (SELECT unnest(range(0, 20))::INTEGER AS b2) x, LATERAL (SELECT b2 AS bin2)),\n", ""))
def a16(t: Tables) -> DataFrame:
    return rounded(weighted.histogram(rows(t), ["query_id", "variable"], "score", "weight"))


@query("D2_dispersion", "WITH " + W + CUM + CORE + """
SELECT query_id, variable, n_units, round(core_share, 6) AS core_share, window_lo::INTEGER AS window_lo, (window_lo + 30)::INTEGER AS window_hi, round(tie, 6) AS tie, coherence FROM d""")
def d2(t: Tables) -> DataFrame:
    keys = ["query_id", "variable"]
    return rounded(dispersion.dispersion(weighted.pooled(rows(t), keys, "unit_id", "score", "weight"), keys, "score"))


MODES = """,
sp AS (SELECT query_id, variable, """ + _q(0.1, "a") + ", " + _q(0.9, "z") + """ FROM c GROUP BY 1, 2),
gp AS (SELECT query_id, variable, score, unit_id, ns - score AS gap, cum, sum(sh * score) OVER (PARTITION BY query_id, variable ORDER BY score, unit_id ROWS UNBOUNDED PRECEDING) AS below, sum(sh * score) OVER (PARTITION BY query_id, variable) AS total FROM c),
ft AS (SELECT *, row_number() OVER (PARTITION BY query_id, variable ORDER BY gap DESC, score) AS o FROM gp JOIN sp USING (query_id, variable) WHERE z - a > 0 AND gap > 0.5 * (z - a) AND round(cum, 12) >= 0.2 AND round(1 - cum, 12) >= 0.2),
mo AS (SELECT query_id, variable, CASE WHEN ft.o IS NULL THEN 'unimodal' ELSE 'two_regime' END AS modality, gap, cum AS lw, below / cum AS lc, (total - below) / (1 - cum) AS hc FROM sp LEFT JOIN (SELECT * EXCLUDE (a, z) FROM ft WHERE o = 1) ft USING (query_id, variable))"""


@query("B6_modality", "WITH " + W + CUM + MODES + """
SELECT query_id, variable, modality, round(gap, 6) AS gap, round(lw, 6) AS low_weight, round(lc, 6) AS low_center, round(hc, 6) AS high_center FROM mo""")
def b6(t: Tables) -> DataFrame:
    keys = ["query_id", "variable"]
    return rounded(dispersion.modality(weighted.cumulated(rows(t), keys, "unit_id", "score", "weight"), keys, "score"))


def _labelled(t: Tables) -> DataFrame:
    return weights(t).join(variables(t).select("unit_id", F.when(F.col("unit_id") % 13 != 0, F.col("segment")).alias("label")), "unit_id")


L = W + ", lb AS (SELECT query_id, ws.unit_id, weight, CASE WHEN ws.unit_id % 13 <> 0 THEN segment END AS label FROM ws JOIN va ON va.unit_id = ws.unit_id)"
P = """, cv AS (SELECT query_id, sum(CASE WHEN label IS NOT NULL THEN weight ELSE 0 END) AS coverage, count(label) AS n_units FROM lb GROUP BY 1),
p0 AS (SELECT query_id, label, sum(weight) AS s FROM lb WHERE label IS NOT NULL GROUP BY 1, 2), p AS (SELECT query_id, label, s / sum(s) OVER (PARTITION BY query_id) AS share FROM p0)"""


@query("B3_class_mixture", "WITH " + L + P + """,
m AS (SELECT query_id, arg_max(label, share) AS modal_class, max(share) AS modal_share, count(*) AS n_classes, sum(share * share) AS concentration FROM p WHERE share >= 1e-6 GROUP BY 1)
SELECT query_id, 'class_mixture' AS method, CASE WHEN coverage < 1e-9 THEN 'no_data' WHEN coverage < 0.5 THEN 'low_coverage' ELSE 'ok' END AS status, n_units, round(coverage, 6) AS coverage, modal_class,
       round(modal_share, 6) AS modal_share, n_classes, round(concentration, 6) AS concentration, CASE WHEN modal_share >= 0.85 THEN 'concentrated' WHEN modal_share IS NOT NULL THEN 'mixed' END AS coherence
FROM cv LEFT JOIN m USING (query_id)""")
def b3(t: Tables) -> DataFrame:
    return rounded(blocks.class_mixture(_labelled(t)).drop("mixture"))


@query("A17_concentration_entropy", "WITH " + L + P + """
SELECT query_id, arg_max(label, share) AS modal_class, round(max(share), 6) AS modal_share, count(*) AS n_classes, round(sum(share * share), 6) AS concentration, round(-sum(share * log2(share)), 6) AS entropy,
       round(CASE WHEN count(*) = 1 THEN 0 ELSE -sum(share * log2(share)) / log2(count(*)) END, 6) AS evenness FROM p GROUP BY 1""")
def a17(t: Tables) -> DataFrame:
    return rounded(weighted.mixture(weighted.shares(_labelled(t), ["query_id"], "label", "weight"), ["query_id"], "label"))


@query("B2_dominant_unit", "WITH " + W + """
SELECT query_id, 'dominant_unit' AS method, count(*) AS n_units, arg_max(unit_id, [coalesce(n_orders, '-Infinity'::DOUBLE), -unit_id]) AS dominant_id,
       arg_max(surplus, [coalesce(n_orders, '-Infinity'::DOUBLE), -unit_id]) AS surplus, max(n_orders) AS n_orders, arg_max(surplus, [coalesce(n_orders, '-Infinity'::DOUBLE), -unit_id]) > 0 AS perennial FROM ws JOIN va USING (unit_id) GROUP BY 1""")
def b2(t: Tables) -> DataFrame:
    return blocks.dominant_unit(weights(t).join(variables(t), "unit_id"), "n_orders", ["surplus", "n_orders"], least="surplus")


def _flags(t: Tables) -> DataFrame:
    endo = F.when(F.col("unit_id") % 5 == 0, 1).when(F.col("unit_id") % 7 == 0, 2).otherwise(0)
    flags = weights(t).withColumn("endo", endo)
    return flags.withColumn("coast", F.when((F.col("endo") == 0) & (F.col("unit_id") % 3 == 0), 1).otherwise(0))


FL = W + ", fl AS (SELECT *, CASE WHEN endo = 0 AND unit_id % 3 = 0 THEN 1 ELSE 0 END AS coast FROM (SELECT *, CASE WHEN unit_id % 5 = 0 THEN 1 WHEN unit_id % 7 = 0 THEN 2 ELSE 0 END AS endo FROM ws))"


@query("B4_outlet_type", "WITH " + FL + """
SELECT query_id, (endo * 10 + coast)::INTEGER AS outlet_id, round(sum(weight), 6) AS share, CASE endo * 10 + coast WHEN 0 THEN 'inland, drains onward' WHEN 1 THEN 'coastal outlet' WHEN 10 THEN 'endorheic sink' ELSE 'endorheic, drains to a sink' END AS outlet_type
FROM fl GROUP BY query_id, endo * 10 + coast HAVING sum(weight) >= 1e-6""")
def b4(t: Tables) -> DataFrame:
    return rounded(blocks.outlet_types(_flags(t), "endo", "coast"))


@query("B4_coast_fraction", "WITH " + FL + " SELECT query_id, count(*) AS n_units, round(sum(coast * weight), 6) AS fraction FROM fl GROUP BY 1")
def b4_coast(t: Tables) -> DataFrame:
    return rounded(blocks.flag_fraction(_flags(t), "coast"))


@query("P2_payload", None)
def p2(t: Tables) -> DataFrame:
    keys = ["query_id", "variable"]
    cum = weighted.cumulated(rows(t), keys, "unit_id", "score", "weight")
    marked = blocks.apply_modality(signature(t), dispersion.modality(cum, keys, "score").select(*keys, "modality", "low_weight", "low_center", "high_center"))
    marked = marked.withColumn("caveat", F.filter(F.array(F.when(F.col("coverage") < 0.99, "partial"), F.when(F.col("modality") == "two_regime", "two_regime")), lambda x: x.isNotNull()))
    fields = ["query_id", "variable", "method", "status", "n_units", "representative_score", "coverage", "coherence", "modality", "suppressed_score", "caveat"]
    return blocks.payload(marked.select(*fields), "area", {"partial": "Part of the area has no data.", "two_regime": "Two separate regimes; no single score is given."})


@query("P5_frame_diff", """
WITH a AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey::DOUBLE AS v FROM nation),
b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END AS name, CASE WHEN n_nationkey = 5 THEN n_regionkey + 0.5 WHEN n_nationkey = 6 THEN n_regionkey + 0.001 ELSE n_regionkey END::DOUBLE AS v FROM nation WHERE n_nationkey <> 7)
SELECT k, 'name' AS "column", a.name AS actual, b.name AS reference FROM a JOIN b USING (k) WHERE a.name IS DISTINCT FROM b.name
UNION ALL SELECT k, 'v', a.v::VARCHAR, b.v::VARCHAR FROM a JOIN b USING (k) WHERE abs(a.v - b.v) > 0.01
UNION ALL SELECT k, '(row)', 'true', NULL FROM a WHERE k NOT IN (SELECT k FROM b)""")
def p5(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("v"))
    k = F.col("k")
    b = a.where(k != 7).withColumn("name", F.when(k == 3, "X").otherwise(F.col("name"))).withColumn("v", F.when(k == 5, F.col("v") + 0.5).when(k == 6, F.col("v") + 0.001).otherwise(F.col("v")))
    return blocks.diff(a, b, ["k"])


SC = "WITH " + W
for _name, _f, _sql in (
    ("W1_percent_rank", position.percent_rank, "100 * percent_rank() OVER (PARTITION BY variable ORDER BY raw)"),
    ("W2_log_percent_rank", position.log_percent_rank, "100 * percent_rank() OVER (PARTITION BY variable ORDER BY ln(1 + greatest(0, raw)))"),
    ("W5_average_rank", position.average_rank, "100 * (rank() OVER (PARTITION BY variable ORDER BY raw) + (count(*) OVER (PARTITION BY variable, raw) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY variable) - 1)"),
    ("W6_rank_share", position.rank_share, "100 * (rank() OVER (PARTITION BY variable ORDER BY raw) + (count(*) OVER (PARTITION BY variable, raw) - 1) / 2.0) / count(*) OVER (PARTITION BY variable)"),
):

    @query(_name, SC + f" SELECT unit_id, variable, raw, round({_sql}, 6) AS score FROM lo WHERE raw IS NOT NULL UNION ALL SELECT unit_id, variable, raw, NULL FROM lo WHERE raw IS NULL")
    def _rank(t: Tables, f=_f) -> DataFrame:
        return rounded(f(position.neutral_long(variables(t), "unit_id", VARIABLES), "raw", ["variable"]))


@query("W3_zero_aware_rank", SC + """ SELECT unit_id, variable, raw, CASE WHEN raw <= 0 THEN 0.0 WHEN raw > 0 THEN round(100 * percent_rank() OVER (PARTITION BY variable, raw > 0 ORDER BY raw), 6) END AS score FROM lo""")
def w3(t: Tables) -> DataFrame:
    return rounded(position.zero_aware_rank(position.neutral_long(variables(t), "unit_id", VARIABLES), "raw", ["variable"]))


@query("W7_share_at_most", SC + """ SELECT variable, round(100 * avg((raw <= m)::INT), 6) AS pct FROM lo JOIN (SELECT variable, avg(raw) AS m FROM lo JOIN ws USING (unit_id) WHERE query_id = 3 GROUP BY 1) USING (variable) WHERE raw IS NOT NULL GROUP BY 1""")
def w7(t: Tables) -> DataFrame:
    long = position.neutral_long(variables(t), "unit_id", VARIABLES)
    means = long.join(weights(t).where("query_id = 3").select("unit_id"), "unit_id", "left_semi").groupBy("variable").agg(F.avg("raw").alias("m"))
    return rounded(long.join(F.broadcast(means), "variable").groupBy("variable").agg(position.share_at_most(long, "raw", F.col("m")).alias("pct")))
