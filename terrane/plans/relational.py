"""Filters, joins, aggregates, windows, sorts and unions on the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import scalars
from terrane.operators import lookup, position, weighted
from terrane.plans.registry import Tables, money, query, rounded
from terrane.streaming.log import windowed_counts

N = "c_nationkey"


@query("S1_scan_projection", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01' AND l_quantity < 5")
def s1(t: Tables) -> DataFrame:
    return t.lineitem.where((F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp")) & (F.col("l_quantity") < 5)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("S2_key_set_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000)")
def s2(t: Tables) -> DataFrame:
    keys = t.orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name", "c_acctbal").join(keys, "c_custkey", "left_semi")


@query("S12_keep_last_merge", """SELECT DISTINCT ON (l_partkey) l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_partkey, l_orderkey DESC, l_linenumber DESC""")
def s12(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", F.struct("l_orderkey", "l_linenumber").alias("batch"))
    return lookup.keep_last(rows, ["l_partkey"], "batch").drop("batch")


@query("S13_resume_anti_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05)")
def s13(t: Tables) -> DataFrame:
    return lookup.upsert_new(t.lineitem.where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey")), t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query("F1_nodata_to_null", "SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer")
def f1(t: Tables) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 17 == 0, scalars.NODATA).otherwise(F.col("c_acctbal"))
    return t.customer.select("c_custkey", scalars.known(raw).alias("v"))


@query("F2_descaled", "SELECT p_partkey, CASE WHEN p_partkey % 17 <> 0 THEN p_size / 10.0::DOUBLE END AS slope, CASE WHEN p_partkey % 17 <> 0 THEN p_size::DOUBLE END AS elevation FROM part")
def f2(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 17 == 0, scalars.NODATA).otherwise(F.col("p_size"))
    return t.part.select("p_partkey", scalars.descaled(raw, "slp_dg_sav").alias("slope"), scalars.descaled(raw, "ele_mt_sav").alias("elevation"))


@query("F3_delta", "SELECT c_custkey, round(CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 THEN c_acctbal - 100 * c_nationkey END, 6) AS delta FROM customer")
def f3(t: Tables) -> DataFrame:
    local = F.when(F.col("c_custkey") % 17 == 0, scalars.NODATA).otherwise(F.col("c_acctbal"))
    upstream = F.when(F.col("c_custkey") % 19 == 0, scalars.NODATA).otherwise(100 * F.col(N))
    return rounded(t.customer.select("c_custkey", scalars.delta(local, upstream).alias("delta")))


@query("F5_bbox_flag", "SELECT c_custkey, (c_custkey % 180 - 90 BETWEEN -10 AND 20 AND c_nationkey * 14 - 175 BETWEEN 0 AND 60) AS in_view, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 6) AS anomaly FROM customer")
def f5(t: Tables) -> DataFrame:
    inside = scalars.in_range(F.col("c_custkey") % 180 - 90, -10, 20) & scalars.in_range(F.col(N) * 14 - 175, 0, 60)
    mean = t.customer.agg(F.avg("c_acctbal").alias("m"))  # of all rows, whatever the view
    return rounded(t.customer.join(F.broadcast(mean)).select("c_custkey", inside.alias("in_view"), (F.col("c_acctbal") - F.col("m")).alias("anomaly")))


@query("F6_interval_containment", "SELECT c_custkey, y AS year FROM customer, (SELECT unnest([1996, 1998, 2000]) AS y) WHERE y BETWEEN 1995 + c_nationkey % 4 AND 1997 + c_custkey % 5")
def f6(t: Tables) -> DataFrame:
    years = t.customer.select("c_custkey", N, F.explode(F.array(*map(F.lit, (1996, 1998, 2000)))).alias("year"))
    return years.where(F.col("year").between(1995 + F.col(N) % 4, 1997 + F.col("c_custkey") % 5)).select("c_custkey", "year")


@query("F7_boolean_nulls", "SELECT count(*) FILTER (WHERE coalesce(f, false)) AS flagged, count(*) FILTER (WHERE NOT coalesce(f, false)) AS clear, count(*) FILTER (WHERE f IS NULL) AS missing FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS f FROM customer)")
def f7(t: Tables) -> DataFrame:
    f = F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False)
    set_ = F.coalesce(f, F.lit(False))
    return t.customer.agg(F.count_if(set_).alias("flagged"), F.count_if(~set_).alias("clear"), F.count_if(f.isNull()).alias("missing"))


@query("F9_text_match", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%e1%' OR lower(p_type) LIKE '%steel' OR p_brand LIKE 'Brand#1%'")
def f9(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").ilike("%e1%") | F.lower("p_type").like("%steel") | F.col("p_brand").like("Brand#1%")).select("p_partkey", "p_name")


@query("F10_nullif_greatest_least", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(floor(l_quantity / 10), 0), 4) AS per_ten, greatest(l_discount, l_tax) AS hi, least(l_discount, l_tax) AS lo FROM lineitem")
def f10(t: Tables) -> DataFrame:
    per = F.col("l_extendedprice") / F.nullif(F.floor(F.col("l_quantity") / 10).cast("double"), F.lit(0.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(per, 4).alias("per_ten"), F.greatest("l_discount", "l_tax").alias("hi"), F.least("l_discount", "l_tax").alias("lo"))


@query("J1_inner_join", "SELECT r_name, n_name, count(*) AS customers, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2")
def j1(t: Tables) -> DataFrame:
    by = t.customer.groupBy(N).agg(F.count("*").alias("customers"), F.sum(money("c_acctbal")).cast("double").alias("balance"))
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return by.join(named, F.col(N) == F.col("n_nationkey")).select("r_name", "n_name", "customers", "balance")


@query("J2_left_chain_null_codes", """SELECT c_custkey, n_name, r_name, s_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey NOT IN (3, 4) LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def j2(t: Tables) -> DataFrame:
    coded = t.nation.where(~F.col("n_nationkey").isin(3, 4))  # the filter stands in the join, so left rows stay
    first = t.supplier.groupBy("s_nationkey").agg(F.min("s_name").alias("s_name"))
    out = t.customer.join(F.broadcast(coded), F.col(N) == F.col("n_nationkey"), "left").join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.join(lookup.small(first), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name", "s_name")


@query("J3_join_on_text_keys", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey::VARCHAR = n_nationkey::VARCHAR")
def j3(t: Tables) -> DataFrame:
    return t.customer.join(F.broadcast(t.nation), F.col(N).cast("string") == F.col("n_nationkey").cast("string"), "left").select("c_custkey", "n_name")


@query("J5_cross_with_epochs", "SELECT n_nationkey, e AS epoch, count(o_orderkey) AS n_orders FROM nation CROSS JOIN (SELECT unnest([1995, 1997, 1999]) AS e) LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND year(o_orderdate) = e GROUP BY 1, 2")
def j5(t: Tables) -> DataFrame:
    frame = t.nation.select("n_nationkey", F.explode(F.array(*map(F.lit, (1995, 1997, 1999)))).alias("epoch"))
    per = t.orders.withColumn("epoch", F.year("o_orderdate")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col(N).alias("n_nationkey"), "epoch").agg(F.count("*").alias("n"))
    return frame.join(per, ["n_nationkey", "epoch"], "left").select("n_nationkey", "epoch", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("J7_pairs_both_ways", """WITH e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(abs(a.s_acctbal - b.s_acctbal), 2) AS d FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)
SELECT a AS node, b AS neighbour, d FROM e UNION ALL SELECT b, a, d FROM e""")
def j7(t: Tables) -> DataFrame:
    a, b = (t.supplier.select(F.col("s_suppkey").alias(x), "s_nationkey", F.col("s_acctbal").alias(f"v{x}")) for x in "ab")
    # a nation is one key of 25: its pairs are dealt to several tasks by their first member
    parts, slices = max(4, int(t.spark.conf.get("spark.sql.shuffle.partitions"))), 16
    a = a.withColumn("_s", F.pmod(F.xxhash64("a"), F.lit(slices)).cast("int")).repartition(parts, "s_nationkey", "_s")
    b = b.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(parts, "s_nationkey", "_s")
    pairs = a.join(b.hint("shuffle_hash"), ["s_nationkey", "_s"]).where("a < b").select("a", "b", F.round(F.abs(F.col("va") - F.col("vb")), 2).alias("d"))
    return lookup.both_ways(pairs, "a", "b", ["d"])


@query("J8_correlated_count", "SELECT p_partkey, p_brand, (SELECT count(*) FROM part q WHERE q.p_brand = part.p_brand) AS slices FROM part")
def j8(t: Tables) -> DataFrame:
    counts = t.part.groupBy("p_brand").agg(F.count("*").alias("slices"))
    return t.part.join(F.broadcast(counts), "p_brand").select("p_partkey", "p_brand", "slices")


@query("J9_not_exists_fallback", "SELECT n_nationkey, coalesce((SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey), (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey)) AS best, NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS fallback FROM nation")
def j9(t: Tables) -> DataFrame:
    own = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias("s"))
    rest = t.customer.groupBy(F.col(N).alias("n_nationkey")).agg(F.max("c_acctbal").alias("c"))
    return t.nation.join(own, "n_nationkey", "left").join(rest, "n_nationkey", "left").select("n_nationkey", F.coalesce("s", "c").alias("best"), F.col("s").isNull().alias("fallback"))


@query("J16_validity_join", """WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate::DATE AS lo, coalesce(lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), DATE '2002-12-31') AS hi FROM orders),
q AS (SELECT c_custkey AS k, DATE '1997-01-01' + (c_custkey % 900)::INTEGER AS "at" FROM customer)
SELECT DISTINCT ON (k) k, "at", id, lo, hi FROM q JOIN s USING (k) WHERE "at" BETWEEN lo AND hi ORDER BY k, hi - lo, id""")
def j16(t: Tables) -> DataFrame:
    return lookup.valid_at(_asked(t), _slices(t), "at", "lo", "hi", "k", "id").select("k", "at", "id", "lo", "hi")


def _slices(t: Tables) -> DataFrame:
    nxt = F.lead("lo").over(Window.partitionBy("k").orderBy("ts", "id"))
    s = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.to_date("o_orderdate").alias("lo"))
    return s.withColumn("hi", F.coalesce(nxt, F.lit("2002-12-31").cast("date"))).drop("ts")


def _asked(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), F.date_add(F.lit("1997-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")).alias("at"))


@query("Z2_slice_or_nearest", """WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate::DATE AS lo, coalesce(lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), DATE '2002-12-31') AS hi FROM orders),
q AS (SELECT c_custkey AS k, DATE '1997-01-01' + (c_custkey % 900)::INTEGER AS "at" FROM customer)
SELECT DISTINCT ON (k) k, "at", id, "at" BETWEEN lo AND hi AS exact FROM q JOIN s USING (k) ORDER BY k, "at" BETWEEN lo AND hi DESC, CASE WHEN "at" BETWEEN lo AND hi THEN hi - lo ELSE abs(lo - "at") END, lo, id""")
def z2(t: Tables) -> DataFrame:
    days = _slices(t).withColumn("l", F.unix_date("lo")).withColumn("h", F.unix_date("hi"))
    out = lookup.valid_or_nearest(_asked(t).withColumn("a", F.unix_date("at")), days, "a", "l", "h", "k", "id")
    return out.select("k", "at", "id", "exact")


@query("J17_floor_lookup", """SELECT c_custkey AS k, y AS "at", max(o_orderdate)::DATE AS step, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM (SELECT c_custkey, unnest([DATE '1996-06-30', DATE '1999-06-30']) AS y FROM customer) LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate::DATE <= y GROUP BY 1, 2""")
def j17(t: Tables) -> DataFrame:
    asked = t.customer.select(F.col("c_custkey").alias("k"), F.explode(F.array(*(F.lit(d).cast("date") for d in ("1996-06-30", "1999-06-30")))).alias("at"))
    steps = t.orders.groupBy(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("step")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("id"))
    return lookup.floor_lookup(asked, steps, "at", "step", "k", ["id"])


@query("J18_span_lookup", """WITH s AS (SELECT c_nationkey AS k, year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 3 <> year(o_orderdate) % 3 GROUP BY 1, 2),
q AS (SELECT n_nationkey AS k, 1990 + n_nationkey AS lo, 1991 + n_nationkey AS hi FROM nation)
SELECT DISTINCT ON (k) k, lo, hi, y, n, y BETWEEN lo AND hi AS in_span FROM q LEFT JOIN s USING (k) ORDER BY k, NOT y BETWEEN lo AND hi, CASE WHEN y BETWEEN lo AND hi THEN 0 WHEN y < lo THEN lo - y ELSE y - hi END, y""")
def j18(t: Tables) -> DataFrame:
    steps = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col(N).alias("k"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")).where("k % 3 <> y % 3")
    q = t.nation.select(F.col("n_nationkey").alias("k"), (1990 + F.col("n_nationkey")).alias("lo"), (1991 + F.col("n_nationkey")).alias("hi"))
    return lookup.span_lookup(q, steps, "lo", "hi", "y", ["k"], ["n"])


@query("J19_semi_anti", "SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j19(t: Tables) -> DataFrame:
    has = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    count = lambda how: t.customer.join(has, "c_custkey", f"left_{how}").agg(F.lit(how).alias("kind"), F.count("*").alias("n"))
    return count("semi").unionByName(count("anti"))


@query("A1_grouped_stats", "SELECT o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(stddev_pop(o_totalprice), 4) AS sd FROM orders GROUP BY 1")
def a1(t: Tables) -> DataFrame:
    p = "o_totalprice"
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(money(p)).cast("double").alias("total"), F.round(F.avg(p), 4).alias("mean"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.round(F.stddev_pop(p), 4).alias("sd"))


@query("A3_percentile_cont", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(median(l_extendedprice), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def a3(t: Tables) -> DataFrame:
    return rounded(position.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


@query("A4_floor_percentile", """SELECT c_nationkey, a[floor(0.02 * (len(a) - 1))::INTEGER + 1] AS p2, a[floor(0.25 * (len(a) - 1))::INTEGER + 1] AS p25, a[floor(0.98 * (len(a) - 1))::INTEGER + 1] AS p98 FROM (SELECT c_nationkey, list_sort(list(c_acctbal)) AS a FROM customer GROUP BY 1)""")
def a4(t: Tables) -> DataFrame:
    a = t.customer.groupBy(N).agg(F.sort_array(F.collect_list("c_acctbal")).alias("a"))
    return a.select(N, *(weighted.floor_percentile(F.col("a"), q).alias(n) for n, q in (("p2", 0.02), ("p25", 0.25), ("p98", 0.98))))


@query("A6_zero_fraction", "SELECT l_returnflag, round(avg((l_discount = 0)::INT), 6) AS zero_discount, round(avg((l_tax = 0)::INT), 6) AS zero_tax FROM lineitem GROUP BY 1")
def a6(t: Tables) -> DataFrame:
    return rounded(t.lineitem.groupBy("l_returnflag").agg(weighted.zero_fraction("l_discount").alias("zero_discount"), weighted.zero_fraction("l_tax").alias("zero_tax")))


@query("A7_skewness_kurtosis", "SELECT l_returnflag, round(skewness(l_extendedprice), 5) AS skew, round(kurtosis(l_extendedprice), 5) AS kurt FROM lineitem GROUP BY 1")
def a7(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(weighted.skewness("l_extendedprice"), 5).alias("skew"), F.round(weighted.kurtosis("l_extendedprice"), 5).alias("kurt"))


@query("A8_distinct_filtered", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 25) AS big_suppliers, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1")
def a8(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_suppkey"))).alias("big_suppliers"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query("A9_top_or_other", """WITH c AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1)
SELECT CASE WHEN r <= 5 THEN p_brand ELSE 'Other' END AS p_brand, least(r, 6)::INTEGER AS rank, sum(n)::BIGINT AS n_rows FROM c GROUP BY 1, 2""")
def a9(t: Tables) -> DataFrame:
    return lookup.top_or_other(t.part, [], "p_brand", 5)


@query("A10_crosstab", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def a10(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("A23_correlation", """WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS x, o_custkey::DOUBLE AS y, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS ry FROM orders)
SELECT g, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""")
def a23(t: Tables) -> DataFrame:
    from terrane.operators.position import rank_share

    base = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    ranked = rank_share(rank_share(base, "x", ["g"], "rx"), "y", ["g"], "ry")
    return rounded(ranked.groupBy("g").agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman")))


@query("A24_prefer_present", """SELECT c_nationkey, c_mktsegment, max(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END) AS number, min(CASE WHEN lower(c_name) NOT IN ('unknown', 'customer#000000001') THEN c_name END) AS text FROM customer GROUP BY 1, 2""")
def a24(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("number", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")))
    return lookup.prefer_present(rows, N, "c_mktsegment", "number", "c_name", ["unknown", "customer#000000001"])


@query("W8_gaps_and_islands", """WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER w AS rn, lag(o_orderstatus) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey, o_orderstatus, (sum((rn = 1 OR p IS DISTINCT FROM o_orderstatus)::INT) OVER (PARTITION BY o_custkey ORDER BY rn))::BIGINT AS island FROM l""")
def w8(t: Tables) -> DataFrame:
    return lookup.islands(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus").select("o_custkey", "o_orderkey", "o_orderstatus", "island")


@query("W9_row_number", "SELECT * FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS n FROM part) WHERE n <= 3")
def w9(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t.part.select("p_brand", "p_partkey", F.row_number().over(w).alias("n")).where("n <= 3")


@query("W10_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def w10(t: Tables) -> DataFrame:
    first = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct(-F.col("o_totalprice"), F.col("o_orderkey")))
    return t.orders.groupBy("o_custkey").agg(first.alias("f")).select("o_custkey", "f.o_orderkey", "f.o_totalprice")


@query("W11_min_rank_desc", "SELECT c_custkey, (rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000) DESC))::INTEGER AS r FROM customer")
def w11(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.rank().over(Window.partitionBy(N).orderBy(F.desc(F.floor(F.col("c_acctbal") / 1000)))).alias("r"))


@query("W12_sliding_counts", """SELECT s::INTEGER AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest(range(0, 720, 24)) AS s) JOIN (SELECT floor((epoch(ts) - 1704067200) / 3600)::INTEGER AS h, value FROM events) ON h >= s AND h < s + 72 GROUP BY 1""")
def w12(t: Tables) -> DataFrame:
    h = F.floor((F.unix_timestamp("ts") - 1704067200) / 3600).cast("int")
    rows = t.events.select(h.alias("h"), "value")
    # an event lies in the windows that start up to 71 hours before it: no join
    first = F.greatest(F.lit(0), F.ceil((F.col("h") - 71) / 24).cast("int"))
    starts = F.explode(F.sequence(first, F.least(F.lit(29), F.floor(F.col("h") / 24).cast("int"))))
    last = F.least(F.lit(29), F.floor(F.col("h") / 24).cast("int"))
    return rows.where((F.col("h") >= 0) & (first <= last)).select(starts.alias("n"), "value").select((F.col("n") * 24).alias("start"), "value").groupBy("start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("W13_trajectory", """SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last, round(arg_max(o_totalprice, (o_orderdate, o_orderkey)) - arg_min(o_totalprice, (o_orderdate, o_orderkey)), 4) AS change FROM orders GROUP BY 1""")
def w13(t: Tables) -> DataFrame:
    at = F.struct("o_orderdate", "o_orderkey")
    ends = t.orders.groupBy("o_custkey").agg(F.min_by("o_totalprice", at).alias("first"), F.max_by("o_totalprice", at).alias("last"))
    return ends.withColumn("change", F.round(F.col("last") - F.col("first"), 4))


@query("O2_ordered_top", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, (c_acctbal > 0) DESC, c_acctbal DESC NULLS LAST, c_custkey LIMIT 40")
def o2(t: Tables) -> DataFrame:
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    return t.customer.select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(rank, F.desc(F.col("c_acctbal") > 0), F.desc_nulls_last("c_acctbal"), "c_custkey").limit(40)


@query("X1_union_all", "SELECT 'customer' AS kind, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def x1(t: Tables) -> DataFrame:
    a = t.customer.groupBy(F.col(N).alias("k")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("customer"))
    return a.unionByName(t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("supplier")))


@query("X2_set_operations", "SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def x2(t: Tables) -> DataFrame:
    a, b = t.customer.select(F.col(N).alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).agg(F.lit("both").alias("part"), F.count("*").alias("n")).unionByName(a.subtract(b).agg(F.lit("customers only").alias("part"), F.count("*").alias("n")))


@query("Z5_first_box", "SELECT c_custkey, CASE WHEN c_nationkey * 14 - 175 BETWEEN -20 AND 55 AND c_custkey % 180 - 90 BETWEEN -35 AND 38 THEN 'south' WHEN c_nationkey * 14 - 175 BETWEEN -25 AND 45 AND c_custkey % 180 - 90 BETWEEN 34 AND 72 THEN 'north' WHEN c_nationkey * 14 - 175 BETWEEN 25 AND 180 AND c_custkey % 180 - 90 BETWEEN -10 AND 80 THEN 'east' END AS box FROM customer")
def z5(t: Tables) -> DataFrame:
    df = t.customer.withColumn("lon", F.col(N) * 14 - 175).withColumn("lat", F.col("c_custkey") % 180 - 90)
    return df.select("c_custkey", lookup.first_box(df, "lat", "lon", [("south", -20, -35, 55, 38), ("north", -25, 34, 45, 72), ("east", 25, -10, 180, 80)]).alias("box"))


@query("Z8_grouped_slices", """SELECT regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g') AS name, count(*) AS n_slices, array_to_string(list(p_partkey::VARCHAR ORDER BY p_size, p_partkey), ',') AS slices FROM part GROUP BY 1""")
def z8(t: Tables) -> DataFrame:
    g = t.part.groupBy(scalars.folded(F.col("p_type")).alias("name")).agg(F.array_sort(F.collect_list(F.struct("p_size", "p_partkey"))).alias("s"))
    return g.select("name", F.size("s").cast("long").alias("n_slices"), F.array_join(F.transform("s", lambda x: x["p_partkey"].cast("string")), ",").alias("slices"))


@query("Z9_trait_coverage", "SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE event_type NOT IN ('error') AND user_id IN (SELECT c_custkey FROM customer) GROUP BY 1")
def z9(t: Tables) -> DataFrame:
    return t.events.where(~F.col("event_type").isin("error")).join(t.customer.select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("S15_log_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def s15(t: Tables) -> DataFrame:
    return rounded(windowed_counts(t.events, "ts", "event_type", "value"))
