"""Statement rules over the signatures of terrane.plans.signature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import scalars
from terrane.operators import statements
from terrane.plans import signature as sig
from terrane.plans.registry import Tables, query, rounded

BASE = "WITH " + sig.W + sig.CUM + sig.QS + sig.CORE + sig.ZF + """,
s AS (SELECT query_id, variable, CASE WHEN coverage < 1e-9 THEN 'no_data' WHEN zero_fraction >= 0.2 AND weight_at_zero >= 0.9 THEN 'outside_active_domain' ELSE 'ok' END AS status, mean
      FROM b JOIN q USING (query_id, variable) JOIN d USING (query_id, variable) JOIN zf USING (variable)),
g AS (SELECT *, CASE WHEN status = 'ok' THEN mean END AS score FROM s)"""

#: Signature rows that pass through every branch of the rules: one for each customer, from the customer's key.
ROWS = """
WITH k AS (SELECT c_custkey AS k FROM customer),
g AS (SELECT k AS query_id, 'v' || k % 4 AS variable,
        ['area_weighted', 'distribution_only', 'dominant_unit', 'class_mixture'][k % 4 + 1] AS method,
        ['ok', 'ok', 'ok', 'no_data', 'outside_active_domain', 'low_coverage', 'not_areal', 'ok', 'ok', 'ok', 'ok'][k % 11 + 1] AS status,
        ['buffer', 'polity', 'single_unit'][k % 3 + 1] AS scope, k % 9 + 1 AS area_units, least(k % 9 + 1, k % 5 + 1) AS n_units,
        CASE WHEN k % 13 <> 0 THEN CASE WHEN k % 6 = 0 THEN 0.0 ELSE (k % 101)::DOUBLE END END AS score,
        CASE WHEN k % 17 <> 0 THEN CASE WHEN k % 12 = 0 THEN 0.0 ELSE k % 50 / 4.0 END END AS raw,
        k % 19 = 0 AS suppressed, CASE WHEN k % 23 <> 0 THEN k % 7 / 10.0 END AS wz, CASE WHEN k % 29 <> 0 THEN k % 10 / 10.0 END AS cov,
        CASE WHEN k % 7 <> 0 THEN k % 7 / 20.0 END AS zf, k % 4 / 50.0 AS short, CASE WHEN k % 5 <> 0 THEN k % 5 / 10.0 END AS lt_half,
        k % 8 / 8.0 AS core, k % 70 AS lo, CASE WHEN k % 31 <> 0 THEN (k % 40)::DOUBLE END AS p10, (40 + k % 60)::DOUBLE AS p90,
        [NULL, 'concentrated', 'spread', 'split', 'mixed'][k % 5 + 1] AS tag, (k % 30)::DOUBLE AS mn, CASE WHEN k % 37 <> 0 THEN (50 + k % 50)::DOUBLE END AS mx,
        CASE WHEN k % 3 <> 0 THEN (k % 20)::DOUBLE END AS lc, (60 + k % 20)::DOUBLE AS hc, (k % 5 + 1) / 6.0 AS top, k % 3 / 10.0 AS rest, k % 4 AS classes FROM k)"""


def _rows(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda n, *xs: F.array(*map(F.lit, xs))[(k % n).cast("int")]
    real = lambda c: c.cast("double")
    return t.customer.select(
        k.alias("query_id"), F.concat(F.lit("v"), k % 4).alias("variable"),
        pick(4, "area_weighted", "distribution_only", "dominant_unit", "class_mixture").alias("method"),
        pick(11, "ok", "ok", "ok", "no_data", "outside_active_domain", "low_coverage", "not_areal", "ok", "ok", "ok", "ok").alias("status"),
        pick(3, "buffer", "polity", "single_unit").alias("scope"), (k % 9 + 1).alias("area_units"), F.least(k % 9 + 1, k % 5 + 1).alias("n_units"),
        F.when(k % 13 != 0, F.when(k % 6 == 0, 0.0).otherwise(real(k % 101))).alias("representative_score"),
        F.when(k % 17 != 0, F.when(k % 12 == 0, 0.0).otherwise(k % 50 / 4)).alias("representative_raw"),
        (k % 19 == 0).alias("suppressed"), F.when(k % 23 != 0, k % 7 / 10).alias("weight_at_zero"), F.when(k % 29 != 0, k % 10 / 10).alias("coverage"),
        F.when(k % 7 != 0, k % 7 / 20).alias("zero_fraction"), (k % 4 / 50).alias("shortfall"), F.when(k % 5 != 0, k % 5 / 10).alias("lt_half"), (k % 3 / 10).alias("lt_fifth"),
        (k % 8 / 8).alias("core_share"), (k % 70).cast("int").alias("window_lo"), F.when(k % 31 != 0, real(k % 40)).alias("p10"), real(40 + k % 60).alias("p90"),
        pick(5, None, "concentrated", "spread", "split", "mixed").alias("coherence"), real(k % 30).alias("least"), F.when(k % 37 != 0, real(50 + k % 50)).alias("most"),
        F.when(k % 3 != 0, real(k % 20)).alias("low_center"), real(60 + k % 20).alias("high_center"), ((k % 5 + 1) / 6).alias("top_share"), (k % 3 / 10).alias("rest_share"),
        (k % 4).alias("n_classes"), F.lit("c").alias("modal_class"),
    )


def _rule(rule: str, reason: str, stat: str, always: bool = False) -> str:
    shown = f"round(({stat})::DOUBLE, 6)"
    return f"SELECT query_id, '{rule}' AS rule, r IS NULL AS applies, r AS reason, {shown if always else f'CASE WHEN r IS NULL THEN {shown} END'} AS stat FROM (SELECT *, CASE {reason} END AS r FROM g)"


def _union(*rules: tuple) -> str:
    return ROWS + "\n" + "\nUNION ALL ".join(_rule(*r) for r in rules)


def _told(t: Tables, rules: list[statements.Rule]) -> DataFrame:
    return rounded(statements.evaluate(_rows(t), rules, ["query_id"]).drop("text"))


STATUS = "WHEN status <> 'ok' THEN 'status:' || status"
CONT = "WHEN method NOT IN ('area_weighted', 'distribution_only') THEN 'method:' || method"
CONT1 = "WHEN method NOT IN ('area_weighted', 'distribution_only', 'dominant_unit') THEN 'method:' || method"
ONE_UNIT = "WHEN area_units = 1 THEN 'one_unit'"
SINGLE = f"{CONT1} {STATUS} WHEN area_units <> 1 THEN 'multi_unit'"
AWARE = "coalesce(method IN ('area_weighted', 'distribution_only') AND zf >= 0.2, false)"
EMPTY = "WHEN raw IS NULL OR score IS NULL THEN 'no_value'"


@query("Y1_position_rules", _union(
    ("POS-01", f"{SINGLE} {EMPTY} WHEN raw = 0 AND score = 0 THEN 'zero_value' WHEN {AWARE} THEN 'zero_aware_variable'", "score"),
    ("POS-02", f"{CONT} {ONE_UNIT} {STATUS} WHEN suppressed THEN 'suppressed' WHEN score IS NULL THEN 'no_value' WHEN score = 0 THEN 'all_at_bottom'", "score"),
    ("POS-03", f"{SINGLE} WHEN raw IS NULL THEN 'no_value'", "raw"),
    ("POS-04", f"{SINGLE} WHEN NOT coalesce(raw = 0 AND score = 0, false) THEN 'not_zero'", "0"),
    ("POS-05", f"{SINGLE} WHEN NOT {AWARE} THEN 'not_zero_aware' {EMPTY} WHEN raw = 0 AND score = 0 THEN 'zero_value'", "score"),
    ("POS-06", f"{CONT} {ONE_UNIT} {STATUS} WHEN wz IS NULL OR coalesce(cov, 0) = 0 THEN 'no_weight' WHEN wz / cov < 0.01 THEN 'below_floor'", "wz / cov"),
    ("POS-07", f"WHEN method <> 'dominant_unit' THEN 'method:' || method {ONE_UNIT} {STATUS} {EMPTY}", "score")))
def y1(t: Tables) -> DataFrame:
    return _told(t, statements.position_rules())


@query("Y2_empty_rules", _union(
    ("EMP-01", "WHEN status <> 'outside_active_domain' THEN 'status:' || status WHEN area_units <> 1 THEN 'multi_unit'", "zf"),
    ("EMP-02", f"WHEN status <> 'outside_active_domain' THEN 'status:' || status {ONE_UNIT} WHEN wz IS NULL THEN 'no_weight'", "wz"),
    ("EMP-03", "WHEN status <> 'no_data' THEN 'status:' || status", "NULL"),
    ("EMP-04", "WHEN status <> 'not_areal' THEN 'status:' || status", "NULL"),
    ("EMP-05", "WHEN status <> 'low_coverage' THEN 'status:' || status", "cov"),
    ("EMP-06", f"{STATUS} WHEN NOT suppressed THEN 'not_suppressed' WHEN lc IS NULL THEN 'no_regimes'", "hc - lc")))
def y2(t: Tables) -> DataFrame:
    return _told(t, statements.empty_rules())


@query("Y3_local_upstream_rules", ROWS + """,
u AS (SELECT a.*, b.status AS us, b.score AS uscore, b.raw AS uraw, b.suppressed AS usup, b.query_id IS NOT NULL AS paired,
             a.status = 'ok' AND NOT a.suppressed AND coalesce(a.score <> 0, false) AND coalesce(b.status = 'ok' AND NOT b.suppressed AND b.score <> 0, false) AS both_
      FROM g a LEFT JOIN g b ON b.query_id = 2 * a.query_id),
r AS (SELECT query_id, 'LU-01' AS rule, CASE WHEN NOT paired THEN 'no_partner' WHEN NOT both_ THEN 'side_not_usable' WHEN area_units <> 1 THEN 'multi_unit' END AS reason, abs(uscore - score) AS s FROM u
UNION ALL SELECT query_id, 'LU-02', CASE WHEN NOT paired THEN 'no_partner' WHEN NOT both_ THEN 'side_not_usable' WHEN area_units = 1 THEN 'one_unit' END, abs(uscore - score) FROM u
UNION ALL SELECT query_id, 'LU-03', CASE WHEN NOT paired THEN 'no_partner' WHEN area_units <> 1 THEN 'multi_unit' WHEN raw IS NULL OR uraw IS NULL THEN 'no_raw' END, NULL FROM u
UNION ALL SELECT query_id, 'LU-04', CASE WHEN NOT paired THEN 'no_partner' WHEN both_ THEN 'both_usable' END, NULL FROM u
UNION ALL SELECT query_id, 'LU-05', CASE WHEN paired THEN 'has_partner' END, NULL FROM u)
SELECT query_id, rule, reason IS NULL AS applies, reason, CASE WHEN reason IS NULL THEN round(s, 6) END AS stat FROM r""")
def y3(t: Tables) -> DataFrame:
    here = _rows(t)
    there = here.select((F.col("query_id") / 2).alias("_id"), *(F.col(c).alias(f"up_{c}") for c in ("status", "representative_score", "representative_raw", "suppressed")), F.lit(True).alias("_there"))
    both = here.join(there, F.col("query_id").cast("double") == F.col("_id"), "left").withColumn("paired", F.coalesce("_there", F.lit(False)))
    return rounded(statements.evaluate(both, statements.pair_rules(), ["query_id"]).drop("text"))


@query("Y4_coverage_rules", _union(
    ("COV-01", "WHEN scope = 'single_unit' THEN 'single_unit' WHEN short < 0.01 THEN 'below_floor'", "CASE WHEN scope <> 'single_unit' THEN short END", True),
    ("COV-02", "WHEN scope = 'single_unit' THEN 'single_unit'", "area_units"),
    ("COV-03", f"WHEN scope = 'single_unit' THEN 'single_unit' WHEN method = 'dominant_unit' THEN 'method:' || method {STATUS} WHEN cov IS NULL THEN 'no_value' WHEN n_units >= area_units THEN 'all_units'", "cov / (1 - short)"),
    ("COV-04", "WHEN scope <> 'polity' THEN 'scope:' || scope WHEN lt_half IS NULL THEN 'no_field'", "lt_half")))
def y4(t: Tables) -> DataFrame:
    return _told(t, [*statements.coverage_rules(), *statements.row_coverage_rules()])


DIS = f"{CONT} {ONE_UNIT} {STATUS} WHEN suppressed THEN 'suppressed' WHEN score IS NULL THEN 'no_value'"
FEW = f"{DIS} WHEN area_units < 5 THEN 'fewer_than_5'"


@query("Y5_distribution_rules", _union(
    ("DIS-01", FEW + " WHEN core IS NULL OR lo IS NULL THEN 'no_window'", "core"),
    ("DIS-02", FEW + " WHEN p10 IS NULL OR p90 IS NULL THEN 'no_quantiles'", "p90 - p10"),
    ("DIS-03", DIS + " WHEN method <> 'area_weighted' THEN 'no_distribution_block' WHEN mn IS NULL OR mx IS NULL THEN 'no_min_max'", "mx - mn"),
    ("DIS-04", FEW + " WHEN coalesce(tag, '') <> 'split' THEN 'coherence:' || coalesce(tag, 'None')", "1 - core"),
    ("DIS-05", DIS + " WHEN area_units >= 5 THEN 'five_or_more'", "area_units"),
    ("DIS-06", FEW + " WHEN coalesce(tag, '') NOT IN ('concentrated', 'spread') THEN 'coherence:' || coalesce(tag, 'None')", "core")))
def y5(t: Tables) -> DataFrame:
    return _told(t, statements.distribution_rules())


MIX = "WHEN method <> 'class_mixture' THEN 'method:' || method WHEN status NOT IN ('ok', 'low_coverage') THEN 'status:' || status WHEN classes = 0 THEN 'no_mixture'"


@query("Y6_categorical_rules", _union(
    ("CAT-01", MIX + " WHEN area_units <> 1 THEN 'multi_unit'", "top"),
    ("CAT-02", f"{MIX} {ONE_UNIT}", "top"),
    ("CAT-03", f"{MIX} {ONE_UNIT} WHEN classes = 1 THEN 'one_class'", "rest"),
    ("CAT-04", f"{MIX} {ONE_UNIT} WHEN classes = 1 THEN 'one_class' WHEN coalesce(tag, '') NOT IN ('concentrated', 'mixed') THEN 'coherence:' || coalesce(tag, 'None')", "top")))
def y6(t: Tables) -> DataFrame:
    # every fourth row is a mixture of up to three classes; a key's own four rows would leave none with a single class
    return _told(t, statements.categorical_rules())


#: A query of four rows for each key of an order: variables a, b, c and d.
FOURS = """
WITH g AS (SELECT l_orderkey AS query_id, ['a', 'b', 'c', 'd'][l_linenumber] AS variable, l_orderkey % 3 AS area_units, CASE WHEN l_orderkey % 5 = 0 THEN 'polity' ELSE 'buffer' END AS scope,
                  CASE l_partkey % 9 WHEN 0 THEN 'no_data' WHEN 1 THEN 'outside_active_domain' ELSE 'ok' END AS status, l_quantity::DOUBLE AS raw, CASE WHEN l_suppkey % 7 <> 0 THEN (l_partkey % 101)::DOUBLE END AS score,
                  ['area_weighted', 'dominant_unit', 'class_mixture', 'distribution_only'][l_linenumber] AS method, CASE WHEN l_suppkey % 11 <> 0 THEN l_suppkey % 5 / 10.0 END AS zf, ['A', 'A', 'A', 'B'][l_linenumber] AS band
           FROM lineitem WHERE l_linenumber <= 4)"""


def _fours(t: Tables) -> DataFrame:
    line, part, supp, order = (F.col(f"l_{c}") for c in ("linenumber", "partkey", "suppkey", "orderkey"))
    pick = lambda *xs: F.array(*map(F.lit, xs))[line.cast("int") - 1]
    return t.lineitem.where(line <= 4).select(
        order.alias("query_id"), pick("a", "b", "c", "d").alias("variable"), (order % 3).alias("area_units"), F.when(order % 5 == 0, "polity").otherwise("buffer").alias("scope"),
        F.when(part % 9 == 0, "no_data").when(part % 9 == 1, "outside_active_domain").otherwise("ok").alias("status"), F.col("l_quantity").cast("double").alias("representative_raw"),
        F.when(supp % 7 != 0, (part % 101).cast("double")).alias("representative_score"), F.lit(False).alias("suppressed"),
        pick("area_weighted", "dominant_unit", "class_mixture", "distribution_only").alias("method"), F.when(supp % 11 != 0, supp % 5 / 10).alias("zero_fraction"), pick("A", "A", "A", "B").alias("band"), pick("x", "y", "z", "x").alias("pair"),
        F.concat(F.lit("p"), part, F.lit("-"), order, pick("a", "b", "c", "d")).alias("name"),
    )


def _band(item: str, rule: str, stat: str, why: str, guard: str = "WHEN n IS DISTINCT FROM 1 THEN 'multi_unit'") -> str:
    return f"SELECT query_id, '{rule}' AS rule, '{item}' AS item, r IS NULL AS applies, r AS reason, CASE WHEN r IS NULL THEN round(({stat})::DOUBLE, 6) END AS stat FROM (SELECT *, CASE {guard} {why} END AS r FROM w)"


@query("Y7_within_band_rules", FOURS + """,
w AS (SELECT query_id, max(area_units) AS n, max(scope) AS scope,
  max(CASE WHEN status = 'ok' THEN raw END) FILTER (WHERE variable = 'a') AS ra, max(CASE WHEN status = 'ok' THEN raw END) FILTER (WHERE variable = 'b') AS rb, max(CASE WHEN status = 'ok' THEN raw END) FILTER (WHERE variable = 'c') AS rc,
  max(CASE status WHEN 'ok' THEN raw WHEN 'outside_active_domain' THEN 0 END) FILTER (WHERE variable = 'a') AS fa, max(CASE status WHEN 'ok' THEN raw WHEN 'outside_active_domain' THEN 0 END) FILTER (WHERE variable = 'b') AS fb,
  max(CASE WHEN status = 'ok' THEN score END) FILTER (WHERE variable = 'a') AS sa, max(CASE WHEN status = 'ok' THEN score END) FILTER (WHERE variable = 'b') AS sb, max(CASE WHEN status = 'ok' THEN score END) FILTER (WHERE variable = 'c') AS sc,
  max(status) FILTER (WHERE variable = 'a') AS ta, max(status) FILTER (WHERE variable = 'b') AS tb, max(status) FILTER (WHERE variable = 'c') AS tc FROM g GROUP BY 1)
""" + "\nUNION ALL ".join((
    _band("soil", "WB-01", "ra + rb + rc", "WHEN ra + rb + rc IS NULL THEN 'side_not_usable'"),
    _band("soil_ranks", "WB-02", "greatest(sa, sb, sc) - least(sa, sb, sc)", "WHEN sa + sb + sc IS NULL THEN 'side_not_usable'", ""),
    _band("discharge", "WB-03", "rb / ra", "WHEN ra + rb IS NULL THEN 'row_empty'", "WHEN scope = 'polity' THEN 'not_areal'"),
    _band("temperature", "WB-06", "rc - ra", "WHEN ra + rc IS NULL THEN 'row_empty'"),
    _band("landuse", "WB-08", "fa + fb", "WHEN fa + fb IS NULL THEN 'extent_empty'"),
    _band("wetland_extent", "WB-04", "ra - rb", "WHEN ra - rb IS NULL THEN 'extent_zero_or_empty'"),
    _band("wetland_class", "WB-05", "NULL", "WHEN ta IS DISTINCT FROM 'ok' THEN 'class_absent' WHEN tb IS DISTINCT FROM 'outside_active_domain' OR tc IS DISTINCT FROM 'outside_active_domain' THEN 'extent_positive_or_empty'"),
    _band("elevation", "WB-07", "rc - rb", "WHEN rb + rc IS NULL THEN 'row_empty'"))))
def y7(t: Tables) -> DataFrame:
    groups = {"soil": ("WB-01", ["a", "b", "c"], "sum"), "soil_ranks": ("WB-02", ["a", "b", "c"], "ranks"), "discharge": ("WB-03", ["a", "b"], "ratio"), "temperature": ("WB-06", ["a", "c"], "span"), "landuse": ("WB-08", ["a", "b"], "filled"),
              "wetland_extent": ("WB-04", ["a", "b"], "gap"), "wetland_class": ("WB-05", ["a", "b", "c"], "class"), "elevation": ("WB-07", ["b", "c"], "span")}
    return rounded(statements.within_band(_fours(t), ["query_id"], groups))


@query("Y8_cross_band_rules", FOURS.replace("l_orderkey AS query_id, [", "l_orderkey // 8 AS query_id, 'p' || l_partkey || '-' || l_orderkey || ['a', 'b', 'c', 'd'][l_linenumber] AS variable, ['x', 'y', 'z', 'x'][l_linenumber] AS pair, [", 1).replace("[l_linenumber] AS variable, l_orderkey % 3", "[l_linenumber] AS slot, l_orderkey % 3", 1) + """,
f AS (SELECT *, abs(score - 50) AS far FROM g WHERE method <> 'class_mixture' AND status = 'ok' AND score IS NOT NULL AND (method = 'dominant_unit' OR coalesce(zf < 0.2, false))),
b AS (SELECT query_id, band, count(*) AS m, max(far) AS top FROM f GROUP BY 1, 2),
a AS (SELECT query_id, count(*) AS m, max(far) AS top, count(*) FILTER (WHERE score <= 10 OR score >= 90) AS k, median(far) AS d FROM f GROUP BY 1),
q AS (SELECT DISTINCT query_id FROM g), n AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS band),
v AS (SELECT query_id, band, variable, row_number() OVER (PARTITION BY query_id, band ORDER BY far DESC, variable) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id, band, pair ORDER BY far DESC, variable) AS o FROM f) WHERE o = 1),
w AS (SELECT query_id, variable, row_number() OVER (PARTITION BY query_id ORDER BY far DESC, variable) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pair ORDER BY far DESC, variable) AS o FROM f) WHERE o = 1),
vn AS (SELECT query_id, band, string_agg(variable, ',' ORDER BY rk) AS named FROM v WHERE rk <= 2 GROUP BY 1, 2), wn AS (SELECT query_id, string_agg(variable, ',' ORDER BY rk) AS named FROM w WHERE rk <= 3 GROUP BY 1),
x AS (SELECT query_id, 'XB-01' AS rule, 'band ' || band AS item, coalesce(m >= 3, false) AS applies, 'fewer_than_3' AS why, top AS stat, named FROM q CROSS JOIN n LEFT JOIN b USING (query_id, band) LEFT JOIN vn USING (query_id, band)
UNION ALL SELECT query_id, 'XB-02', '(all bands)', coalesce(m >= 5, false), 'fewer_than_5', top, named FROM q LEFT JOIN a USING (query_id) LEFT JOIN wn USING (query_id)
UNION ALL SELECT query_id, 'XB-03', '(all bands)', coalesce(m >= 5, false), 'fewer_than_5', k / m, NULL FROM q LEFT JOIN a USING (query_id)
UNION ALL SELECT query_id, 'XB-04', '(all bands)', coalesce(m >= 5, false), 'fewer_than_5', d, NULL FROM q LEFT JOIN a USING (query_id))
SELECT query_id, rule, item, applies, CASE WHEN NOT applies THEN why END AS reason, CASE WHEN applies THEN round(stat, 6) END AS stat, CASE WHEN applies THEN named END AS named FROM x""")
def y8(t: Tables) -> DataFrame:
    rows = _fours(t).withColumn("variable", F.col("name")).withColumn("query_id", F.floor(F.col("query_id") / 8))
    return rounded(statements.cross_band(rows, ["query_id"]).withColumn("named", F.array_join("named", ",")))


@query("Y10_water_provenance", """
WITH k AS (SELECT c_custkey, c_custkey AS k FROM customer),
r AS (SELECT *, CASE WHEN k % 7 <> 0 THEN (k % 23) / 10.0 END AS rain, CASE WHEN k % 11 <> 0 THEN (k % 17) / 10.0 END AS dry, CASE WHEN k % 4 <> 0 THEN 0.8 + (k % 5) / 10.0 END AS warm, CASE WHEN k % 13 <> 0 THEN k % 3000 END AS up FROM k)
SELECT c_custkey, CASE WHEN k % 9 = 0 THEN 'endorheic' WHEN k % 5 = 0 AND k % 40 < 10 THEN 'coastal' WHEN NOT coalesce(up < 500, false) AND (coalesce(rain > 1.5, false) OR coalesce(dry > 1.5, false)) THEN 'exogenous'
  WHEN up < 500 THEN 'undetermined' WHEN coalesce(rain BETWEEN 0.9 AND 1.1, true) AND coalesce(dry BETWEEN 0.9 AND 1.1, true) AND coalesce(warm BETWEEN 0.9 AND 1.1, true) THEN 'uniform' ELSE 'local' END AS source FROM r""")
def y10(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    rain, dry = F.when(k % 7 != 0, k % 23 / 10), F.when(k % 11 != 0, k % 17 / 10)
    warm, up = F.when(k % 4 != 0, F.lit(0.8) + k % 5 / 10), F.when(k % 13 != 0, k % 3000)
    return t.customer.select("c_custkey", statements.water_provenance((k % 9 == 0).cast("int"), (k % 5 == 0).cast("int"), k % 40, rain, dry, warm, up).alias("source"))


@query("Y11_classes", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'hyper-arid' WHEN p_size < 20 THEN 'arid' WHEN p_size < 65 THEN 'semi-arid' WHEN p_size < 100 THEN 'sub-humid' ELSE 'humid' END AS aridity,
CASE WHEN p_size / 50.0 < 0.05 THEN 'hyper-arid' WHEN p_size / 50.0 < 0.2 THEN 'arid' WHEN p_size / 50.0 < 0.5 THEN 'semi-arid' WHEN p_size / 50.0 < 0.65 THEN 'dry sub-humid' ELSE 'humid' END AS unep FROM part""")
def y11(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.select("p_partkey", scalars.binned(size, scalars.ARIDITY_EDGES, scalars.ARIDITY_LABELS).alias("aridity"), scalars.binned(size / 50, scalars.UNEP_EDGES, scalars.UNEP_LABELS).alias("unep"))


@query("Y14_leaders", BASE + " SELECT query_id, variable, round(far, 6) AS far, rank FROM (SELECT query_id, variable, abs(score - 50) AS far, (row_number() OVER (PARTITION BY query_id ORDER BY abs(score - 50) DESC, variable))::INTEGER AS rank FROM g WHERE abs(score - 50) >= 5) WHERE rank <= 2")
def y14(t: Tables) -> DataFrame:
    return rounded(statements.leaders(sig.signature(t), ["query_id"], n=2, floor=5.0))


@query("Q_scalar_functions", """SELECT n_nationkey, trim(regexp_replace(regexp_replace(lower(n_name || ' (x)'), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS folded, n_nationkey || CASE WHEN n_nationkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n_nationkey % 10 = 1 THEN 'st' WHEN n_nationkey % 10 = 2 THEN 'nd' WHEN n_nationkey % 10 = 3 THEN 'rd' ELSE 'th' END AS nth,
CASE WHEN n_nationkey - 10 < 1 THEN (11 - n_nationkey) || ' BCE' ELSE (n_nationkey - 10) || ' CE' END AS year, n_nationkey::DOUBLE AS lat, (n_nationkey * -1.5)::DOUBLE AS lon FROM nation""")
def q_scalars(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    place = scalars.lat_lon(F.concat(k.cast("string"), F.lit(", "), (k * -1.5).cast("string")))
    return t.nation.select("n_nationkey", scalars.folded(F.concat("n_name", F.lit(" (x)"))).alias("folded"), scalars.ordinal(k).alias("nth"), scalars.year_label(k - 10).alias("year"), place["lat"].alias("lat"), place["lon"].alias("lon"))
