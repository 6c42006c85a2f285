"""Arrays by year and month: suppliers are cells, years and months of their lines the time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import lookup, series
from terrane.plans.registry import Tables, day_number, money, query, rounded

YEARS = list(range(1995, 2002))

ANNUAL = """c AS (SELECT l_suppkey AS cell, year(l_shipdate)::INTEGER AS y, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
g AS (SELECT s AS cell, y::INTEGER AS y, coalesce(q, 0)::DOUBLE AS v FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem) CROSS JOIN (SELECT unnest(range(1995, 2002)) AS y) LEFT JOIN c ON c.cell = s AND c.y = y)""".replace("c.y = y)", "c.y = yy)").replace("unnest(range(1995, 2002)) AS y)", "unnest(range(1995, 2002)) AS yy)").replace("s AS cell, y::INTEGER AS y", "s AS cell, yy::INTEGER AS y")


def annual(t: Tables) -> DataFrame:
    """(cell, values): quantity by year, 1995 first."""
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("q"))
    m = per.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("y", "q"))).alias("m"))
    return m.select("cell", F.transform(F.array(*map(F.lit, YEARS)), lambda y: F.coalesce(F.get(F.transform(F.filter(F.map_entries("m"), lambda e: e["key"] == y), lambda e: e["value"]), F.lit(0)), F.lit(0.0))).alias("values"))


@query("T1_clamped_span", "SELECT n_nationkey, greatest(-600 + 100 * n_nationkey, 0) AS lo, least(2100 - 50 * n_nationkey, 1998) AS hi, greatest(-600 + 100 * n_nationkey, -491) AS elo, least(2100 - 50 * n_nationkey, 1890) AS ehi FROM nation")
def t1(t: Tables) -> DataFrame:
    a, b = -600 + 100 * F.col("n_nationkey"), 2100 - 50 * F.col("n_nationkey")
    (lo, hi), (elo, ehi) = series.clamped(a, b, series.GRID_YEARS), series.clamped(a, b, series.EVENT_YEARS)
    return t.nation.select("n_nationkey", lo.alias("lo"), hi.alias("hi"), elo.alias("elo"), ehi.alias("ehi"))


@query("T2_year_slice_stats", f"WITH {ANNUAL} SELECT cell, round(avg(v), 6) AS mean, min(v) AS lo, max(v) AS hi FROM g WHERE y BETWEEN 1996 AND 1999 GROUP BY 1")
def t2(t: Tables) -> DataFrame:
    s = series.year_slice(F.col("values"), 1996, 1999, YEARS[0])
    return annual(t).select("cell", F.round(series.array_mean(s), 6).alias("mean"), F.array_min(s).alias("lo"), F.array_max(s).alias("hi"))


@query("T3_nearest_grid_point", "SELECT c_custkey, (round((c_custkey % 180 - 90 + 0.3) / 2) * 2)::DOUBLE AS lat, ((round(((c_nationkey * 14 - 175 + 360) % 360 + 0.3) / 2) * 2) % 360)::DOUBLE AS lon FROM customer")
def t3(t: Tables) -> DataFrame:
    lat, lon = series.nearest_grid_point(F.col("c_custkey") % 180 - 90 + 0.3, F.col("c_nationkey") * 14 - 175 + 0.3, 2.0)
    return t.customer.select("c_custkey", lat.alias("lat"), lon.alias("lon"))


@query("T4_event_summary", """WITH e AS (SELECT event_id, (epoch(ts)::BIGINT // 86400 - 19723)::INTEGER AS d, value FROM events WHERE event_type = 'error'),
q AS (SELECT n_nationkey AS k, n_nationkey % 10 AS lo, n_nationkey % 10 + n_nationkey AS hi FROM nation)
SELECT k, count(d) AS n_events, round(coalesce(sum(value), 0), 4) AS total, min(CASE WHEN value >= 90 THEN hi - d END) AS years_since_major FROM q LEFT JOIN e ON d BETWEEN lo AND hi AND d BETWEEN 2 AND 25 AND value >= 50 GROUP BY 1""")
def t4(t: Tables) -> DataFrame:
    e = t.events.where("event_type = 'error'").select(day_number("ts", 19723).alias("d"), F.col("value").cast("decimal(28,12)").alias("value"))
    n = F.col("n_nationkey")
    q = t.nation.select(n.alias("k"), (n % 10).alias("lo"), (n % 10 + n).alias("hi"))
    return rounded(series.event_summary(q, e, "k", "lo", "hi", "d", "value", 50.0, 90.0, (2, 25)), 4)


@query("T7_rebaselined_span", f"WITH {ANNUAL} SELECT cell, round(avg(v) FILTER (WHERE y BETWEEN 1998 AND 2000) - avg(v) FILTER (WHERE y BETWEEN 1995 AND 1997), 6) AS anomaly FROM g GROUP BY 1")
def t7(t: Tables) -> DataFrame:
    return rounded(annual(t).select("cell", series.rebaselined(F.col("values"), 1998, 2000, (1995, 1997), YEARS[0]).alias("anomaly")))


@query("T8_period_means", f"WITH {ANNUAL} SELECT cell, round(avg(v) FILTER (WHERE y BETWEEN 1995 AND 1996), 6) AS a, round(avg(v) FILTER (WHERE y BETWEEN 1996 AND 1998), 6) AS b, round(avg(v) FILTER (WHERE y BETWEEN 1998 AND 2001), 6) AS c FROM g GROUP BY 1")
def t8(t: Tables) -> DataFrame:
    spans = {"a": (1995, 1996), "b": (1996, 1998), "c": (1998, 2001)}
    return rounded(annual(t).select("cell", *(series.period_mean(F.col("values"), *s, YEARS[0]).alias(n) for n, s in spans.items())))


BINS = {1: (1, 2), 2: (3, 3), 3: (4, 7)}
SPARSE = f"{ANNUAL}, z AS (SELECT cell, y - 1994 AS p, greatest(v - 190 * (1 + cell % 3), 0) AS v FROM g)"


def _sparse(t: Tables) -> DataFrame:
    return annual(t).select("cell", F.transform("values", lambda v: F.greatest(v - 190 * (1 + F.col("cell") % 3), F.lit(0.0))).alias("values"))


@query("T9_first_bin_T10_persistence", f"WITH {SPARSE}, b AS (SELECT cell, CASE WHEN p <= 2 THEN 1 WHEN p = 3 THEN 2 ELSE 3 END AS k, max(v) AS m FROM z GROUP BY 1, 2) SELECT cell, min(CASE WHEN m > 0 THEN k END)::INTEGER AS first_bin, count(*) FILTER (WHERE m > 0)::INTEGER AS n_bins FROM b GROUP BY 1")
def t9(t: Tables) -> DataFrame:
    return _sparse(t).select("cell", series.first_bin(F.col("values"), BINS).alias("first_bin"), series.bin_count(F.col("values"), BINS).alias("n_bins"))


@query("T11_bin_share", f"WITH {SPARSE} SELECT cell, round(least(1, avg(v) / 500), 6) AS share FROM z WHERE p >= 4 GROUP BY 1")
def t11(t: Tables) -> DataFrame:
    return rounded(_sparse(t).select("cell", series.bin_share(F.col("values"), F.lit(500.0), BINS[3]).alias("share")))


@query("T12_p99_positive", f"WITH {SPARSE} SELECT p::INTEGER AS step, round(quantile_cont(v, 0.99), 6) AS p99 FROM z WHERE v > 0 GROUP BY 1")
def t12(t: Tables) -> DataFrame:
    long = series.exploded(_sparse(t), ["cell"], "values", 1).where("value > 0")
    return long.groupBy("step").agg(F.round(F.percentile("value", 0.99), 6).alias("p99"))


@query("T13_raster_index", "SELECT c_custkey, floor((90 - (c_custkey % 180 - 90)) * 12)::INTEGER AS i, floor(((c_nationkey * 14 - 175 + 180) % 360) * 12)::INTEGER AS j FROM customer")
def t13(t: Tables) -> DataFrame:
    i, j = series.grid_cell((F.col("c_custkey") % 180 - 90).cast("double"), F.col("c_nationkey") * 14 - 175.0, 1 / 12)
    return t.customer.select("c_custkey", i.alias("i"), j.alias("j"))


@query("T15_crosswalk_steps", f"""WITH {ANNUAL}, x AS (SELECT s_nationkey AS unit, s_suppkey AS cell, (1 + s_suppkey % 4) / 4.0 AS share FROM supplier), a AS (SELECT s_nationkey AS unit, 2000.0 * count(*) AS area FROM supplier GROUP BY 1)
SELECT unit, (y - 1995)::INTEGER AS step, round(least(1, sum(v * share) / any_value(area)), 6) AS fraction FROM x JOIN g USING (cell) JOIN a USING (unit) GROUP BY 1, 2""")
def t15(t: Tables) -> DataFrame:
    x = t.supplier.select(F.col("s_nationkey").alias("unit"), F.col("s_suppkey").alias("cell"), ((1 + F.col("s_suppkey") % 4) / 4.0).alias("share"))
    area = t.supplier.groupBy(F.col("s_nationkey").alias("unit")).agg((2000.0 * F.count("*")).alias("area"))
    return rounded(series.crosswalk_steps(annual(t), x, "unit", "cell", "values", "share", area, "area"))


@query("B7a_epoch_totals", f"""WITH {ANNUAL}, x AS (SELECT s_nationkey AS query_id, s_suppkey AS cell, (1 + s_suppkey % 4) / 4.0 AS share FROM supplier)
SELECT query_id, y AS year, round(sum(v * share), 6) AS total, round(sum(share * v) / sum(share), 6) AS mean, count(*) AS n_cells, round(sum(share) ** 2 / sum(share * share), 6) AS w_eff FROM x JOIN g USING (cell) WHERE y IN (1996, 1999) GROUP BY 1, 2""")
def b7a(t: Tables) -> DataFrame:
    x = t.supplier.select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("cell"), ((1 + F.col("s_suppkey") % 4) / 4.0).alias("share"))
    steps = F.explode(series.epoch_steps(F.lit(1995), F.lit(1999), [1993, 1996, 1999, 2002]))
    wanted = series.exploded(annual(t), ["cell"], "values", YEARS[0]).join(F.broadcast(t.spark.range(1).select(steps.alias("step"))), "step")
    s = F.col("share")
    return rounded(x.join(wanted, "cell").groupBy("query_id", F.col("step").alias("year")).agg(
        F.sum(F.col("value") * s).alias("total"), (F.sum(F.col("value") * s) / F.sum(s)).alias("mean"), F.count("*").alias("n_cells"), (F.pow(F.sum(s), F.lit(2)) / F.sum(s * s)).alias("w_eff")))


@query("B7b_annual_weighted_mean", f"""WITH {ANNUAL}, x AS (SELECT s_nationkey AS query_id, s_suppkey AS cell, (1 + s_suppkey % 4) / 4.0 AS share FROM supplier)
SELECT query_id, y AS year, round(sum(v * 86400 * share) / sum(share), 4) AS mean FROM x JOIN g USING (cell) GROUP BY 1, 2""")
def b7b(t: Tables) -> DataFrame:
    x = t.supplier.select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("cell"), ((1 + F.col("s_suppkey") % 4) / 4.0).alias("share"))
    long = series.exploded(annual(t), ["cell"], "values", YEARS[0])
    mean = F.sum(F.col("value") * 86400 * F.col("share")) / F.sum("share")
    return x.join(long, "cell").groupBy("query_id", F.col("step").alias("year")).agg(F.round(mean, 4).alias("mean"))


@query("T16_decadal_means", "SELECT p_brand, (floor(p_size / 10) * 10)::INTEGER AS decade, round(avg(p_retailprice), 6) AS mean, count(*) AS n FROM part GROUP BY 1, 2")
def t16(t: Tables) -> DataFrame:
    return rounded(series.decadal(t.part, ["p_brand"], "p_size", "p_retailprice"))


@query("T17_ensemble_spread", "SELECT l_suppkey AS cell, year(l_shipdate)::INTEGER AS y, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY 1, 2")
def t17(t: Tables) -> DataFrame:
    return rounded(t.lineitem.groupBy(F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("y")).agg(F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("sd")))


@query("T18_epoch_anomaly", f"WITH {ANNUAL} SELECT cell, y AS year, round(v - avg(v) OVER (PARTITION BY cell), 6) AS anomaly FROM g")
def t18(t: Tables) -> DataFrame:
    m = series.array_mean(F.col("values"))
    return rounded(series.exploded(annual(t).select("cell", F.transform("values", lambda v: v - m).alias("values")), ["cell"], "values", YEARS[0]).select("cell", F.col("step").alias("year"), F.col("value").alias("anomaly")))


@query("R12_nearest_large", """SELECT DISTINCT ON (c_custkey) c_custkey, s_suppkey, round(abs(c_acctbal - s_acctbal), 4) AS away FROM customer JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal > 1000 ORDER BY c_custkey, abs(c_acctbal - s_acctbal), s_suppkey""")
def r12(t: Tables) -> DataFrame:
    points = t.supplier.where("s_acctbal > 1000").select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_acctbal")
    asked = t.customer.select("c_custkey", F.col("c_nationkey").alias("k"), "c_acctbal")
    out = lookup.nearest_value(asked, points, "k", "c_acctbal", "s_acctbal", "s_suppkey", ["c_custkey"])
    return out.select("c_custkey", "s_suppkey", F.round("away", 4).alias("away"))


@query("Z3_renormalised_mean", """WITH w AS (SELECT c_nationkey AS k, c_acctbal AS v, 1 + c_custkey % 7 AS o FROM customer WHERE c_custkey % 17 <> 0) SELECT k, count(*) AS n, round(sum(o * v) / sum(o), 6) AS mean FROM w GROUP BY 1""")
def z3(t: Tables) -> DataFrame:
    rows = t.customer.where("c_custkey % 17 <> 0").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"), (1 + F.col("c_custkey") % 7).alias("o"))
    share = F.col("o") / F.sum("o").over(Window.partitionBy("k"))
    return rounded(rows.withColumn("w", share).groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("v")).alias("mean")))


@query("A12_overlap_sum", "SELECT s_nationkey AS k, round(sum(l_extendedprice::DECIMAL(18,2) * (1 + s_suppkey % 4))::DOUBLE / 4, 4) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def a12(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(money("l_extendedprice")).alias("v"))
    out = per.join(t.supplier, "s_suppkey").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum(F.col("v") * (1 + F.col("s_suppkey") % 4)).cast("double").alias("x"))
    return out.select("k", F.round(F.col("x") / 4, 4).alias("total"))
