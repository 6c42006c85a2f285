"""Tables and texts that are written first and read again: scores, statistics, steps, batches, typed text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import scalars
from terrane.operators import blocks, scores, spatialstats, statements
from terrane.plans import signature as sig
from terrane.plans.registry import Tables, query, rounded
from terrane.plans.spatial import EDGES, _edges, _values
from terrane.session import shared_folder
from terrane.sources import files


def _folder(t: Tables, name: str) -> str:
    """A new folder for each call, so that no result depends on an earlier one."""
    return f"{shared_folder(t.spark)}/terrane-{name}-{uuid.uuid4().hex}"


@query("B0_score_table", "WITH " + sig.W.replace("\nw AS", "w AS", 1) + " SELECT unit_id, variable, round(raw, 6) AS raw, round(score, 6) AS score FROM sc")
def b0(t: Tables) -> DataFrame:
    """Two of the variables are stored, then all are asked for: one is ranked, two are read."""
    path, units = _folder(t, "scores"), sig.variables(t)
    scores.refreshed(units, "unit_id", sig.VARIABLES[:2], path)
    out, anew = scores.refreshed(units, "unit_id", sig.VARIABLES, path)
    assert anew == sig.VARIABLES[2:], anew
    return rounded(out)


@query("M8_stored_lisa_lookup", f"""WITH {EDGES}, l AS (SELECT i AS unit, sum(w * z.z) AS lag FROM w JOIN z ON z.unit = w.j GROUP BY 1), s AS (SELECT unit, z, lag, CASE WHEN z > 0 AND lag > 0 THEN 'HH' WHEN z <= 0 AND lag <= 0 THEN 'LL' WHEN z > 0 THEN 'HL' ELSE 'LH' END AS quadrant, round(z * lag / (SELECT avg(z * z) FROM z), 6) AS local_i FROM z JOIN l USING (unit))
SELECT n_nationkey AS asked, quadrant, local_i FROM nation LEFT JOIN s ON unit = n_nationkey * 3""")
def m8(t: Tables) -> DataFrame:
    """Statistics are computed once and stored by quadrant; units are looked up in the stored table."""
    path = _folder(t, "lisa")
    spatialstats.local_moran(_values(t), spatialstats.row_standardised(_edges(t))).write.partitionBy("quadrant").parquet(path)
    asked = t.nation.select(F.col("n_nationkey").alias("asked"), (F.col("n_nationkey") * 3).alias("unit"))
    return rounded(asked.join(t.spark.read.parquet(path).select("unit", "quadrant", "local_i"), "unit", "left").select("asked", "quadrant", "local_i"))


@query("S14_step_folders", "SELECT l_orderkey, l_linenumber, year(l_shipdate)::INTEGER AS step, l_quantity FROM lineitem WHERE year(l_shipdate) IN (1994, 1996)")
def s14(t: Tables) -> DataFrame:
    path = _folder(t, "steps")
    files.write_steps(t.lineitem.select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("step"), "l_quantity"), path, "step")
    return files.read_steps(t.spark, path, "step", [1994, 1996])


@query("S3_typed_text", "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS p_size, p_name, p_retailprice FROM part")
def s3(t: Tables) -> DataFrame:
    """Parts written as tab-separated text, some without a size, and read with a declared schema."""
    path, schema = _folder(t, "text"), "p_partkey bigint, p_size int, p_name string, p_retailprice double"
    t.part.select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"), "p_name", "p_retailprice").write.csv(path, sep="\t", header=True, nullValue="")
    return files.read_tsv(t.spark, path, schema)


@query("S11_insert_ignore", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE 'second' END AS batch FROM customer")
def s11(t: Tables) -> DataFrame:
    """A third of the customers is there already when all of them are inserted."""
    path, k = _folder(t, "insert"), F.col("c_custkey")
    files.insert_ignore(t.customer.where(k % 3 == 0).select(k, F.lit("first").alias("batch")), path, ["c_custkey"])
    files.insert_ignore(t.customer.select(k, F.lit("second").alias("batch")), path, ["c_custkey"])
    return t.spark.read.parquet(path)


@query("S11_merge_last", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS batch, CASE WHEN o_orderkey % 4 = 0 THEN -o_totalprice ELSE o_totalprice END AS total FROM orders")
def s11m(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    there = t.orders.select(k, F.lit(1).alias("batch"), F.col("o_totalprice").alias("total"))
    staged = t.orders.where(k % 4 == 0).select(k, F.lit(2).alias("batch"), (-F.col("o_totalprice")).alias("total"))
    return files.merge_last(staged, there, ["o_orderkey"], "batch")


@query("S6_ensemble_mean", """WITH m AS (SELECT l_suppkey AS cell, month(l_shipdate) AS step, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2) SELECT cell, (row_number() OVER (PARTITION BY cell ORDER BY step))::INTEGER AS place, round(m, 6) AS mean FROM m""")
def s6(t: Tables) -> DataFrame:
    """Line numbers are members of an ensemble, months its steps."""
    runs = t.lineitem.select(F.col("l_suppkey").alias("cell"), F.month("l_shipdate").alias("step"), "l_linenumber", "l_quantity")
    return rounded(files.ensemble_mean(runs, ["cell"], "step", "l_quantity").select("cell", F.posexplode("values").alias("place", "mean")).withColumn("place", F.col("place") + 1))


@query("D4_backfill_single", """WITH s AS (SELECT l_orderkey AS query_id, 'quantity' AS variable, count(*) AS n_units, CASE WHEN l_orderkey % 5 = 0 THEN 'no_data' ELSE 'ok' END AS status, CASE WHEN count(*) < 3 THEN 'concentrated' ELSE 'spread' END AS coherence, min(l_extendedprice) / 7 AS raw FROM lineitem GROUP BY l_orderkey)
SELECT query_id, variable, n_units, status, CASE WHEN n_units = 1 AND status = 'ok' THEN round(raw, 3) END AS representative_raw, CASE WHEN NOT (n_units = 1 AND status = 'ok') THEN coherence END AS coherence FROM s""")
def d4(t: Tables) -> DataFrame:
    k = F.col("l_orderkey")
    rows = t.lineitem.groupBy(k.alias("query_id")).agg(F.count("*").alias("n_units"), (F.min("l_extendedprice") / 7).alias("raw")).withColumn("variable", F.lit("quantity"))
    signature = rows.select("query_id", "variable", "n_units", F.when(F.col("query_id") % 5 == 0, "no_data").otherwise("ok").alias("status"), F.when(F.col("n_units") < 3, "concentrated").otherwise("spread").alias("coherence"))
    return blocks.backfill_single(signature, rows.select("query_id", "variable", "raw")).select("query_id", "variable", "n_units", "status", "representative_raw", "coherence")


#: All texture classes that hundredths sand, silt and clay meet, as a list.
TEXTURE = """list_filter([CASE WHEN {a} > 85 AND {b} + 1.5 * {c} < 15 THEN 'sand' END, CASE WHEN {a} BETWEEN 70 AND 90 AND {b} + 1.5 * {c} >= 15 AND {b} + 2 * {c} < 30 THEN 'loamy sand' END,
CASE WHEN {b} + 2 * {c} >= 30 AND (({c} >= 7 AND {c} < 20 AND {a} > 52) OR ({c} < 7 AND {b} < 50)) THEN 'sandy loam' END, CASE WHEN {c} >= 7 AND {c} < 27 AND {b} >= 28 AND {b} < 50 AND {a} <= 52 THEN 'loam' END,
CASE WHEN {b} >= 50 AND (({c} >= 12 AND {c} < 27) OR ({b} < 80 AND {c} < 12)) THEN 'silt loam' END, CASE WHEN {b} >= 80 AND {c} < 12 THEN 'silt' END, CASE WHEN {c} >= 20 AND {c} < 35 AND {b} < 28 AND {a} > 45 THEN 'sandy clay loam' END,
CASE WHEN {c} >= 27 AND {c} < 40 AND {a} > 20 AND {a} <= 45 THEN 'clay loam' END, CASE WHEN {c} >= 27 AND {c} < 40 AND {a} <= 20 THEN 'silty clay loam' END, CASE WHEN {c} >= 35 AND {a} > 45 THEN 'sandy clay' END,
CASE WHEN {c} >= 40 AND {b} >= 40 THEN 'silty clay' END, CASE WHEN {c} >= 40 AND {a} <= 45 AND {b} < 40 THEN 'clay' END], lambda x: x IS NOT NULL)"""


@query("Y11_texture_class", f"""WITH p AS (SELECT p_partkey, (p_partkey * 7 % 101)::DOUBLE AS sand, (p_partkey * 13 % 101)::DOUBLE AS u FROM part), s AS (SELECT p_partkey, sand, floor((100 - sand) * u / 100) AS silt, 100 - sand - floor((100 - sand) * u / 100) AS clay FROM p),
o AS (SELECT a, b, c FROM (SELECT unnest([-0.5, 0.0, 0.5]) AS a), (SELECT unnest([-0.5, 0.0, 0.5]) AS b), (SELECT unnest([-0.5, 0.0, 0.5]) AS c)),
n AS (SELECT p_partkey, count(DISTINCT {TEXTURE.format(a='(sand + a)', b='(silt + b)', c='(clay + c)')}) AS n FROM s, o GROUP BY 1), w AS (SELECT p_partkey, {TEXTURE.format(a='sand', b='silt', c='clay')} AS t FROM s)
SELECT p_partkey, CASE WHEN len(t) = 1 THEN t[1] END AS texture, len(t) <> 1 OR n > 1 AS unsure FROM w JOIN n USING (p_partkey)""")
def y11t(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    sand, u = (k * 7 % 101).cast("double"), (k * 13 % 101).cast("double")
    silt = F.floor((100 - sand) * u / 100).cast("double")
    shares = t.part.select(k, sand.alias("sand"), silt.alias("silt"), (100 - sand - silt).alias("clay"))
    return shares.select(k, statements.texture(*map(F.col, ("sand", "silt", "clay"))).alias("t")).select(k, F.col("t.name").alias("texture"), F.col("t.unsure").alias("unsure"))


_SLOPE = "CASE WHEN {0} < 1 THEN 'level' WHEN {0} < 2 THEN 'very gently sloping' WHEN {0} < 5 THEN 'gently sloping' WHEN {0} < 10 THEN 'sloping' WHEN {0} < 15 THEN 'strongly sloping' WHEN {0} < 30 THEN 'moderately steep' WHEN {0} < 60 THEN 'steep' ELSE 'very steep' END"
_UNEP = "CASE WHEN {0} < 0.05 THEN 'hyper-arid' WHEN {0} < 0.2 THEN 'arid' WHEN {0} < 0.5 THEN 'semi-arid' WHEN {0} < 0.65 THEN 'dry sub-humid' ELSE 'humid' END"


@query("Y11_slope_and_aridity", f"""WITH p AS (SELECT p_partkey, p_partkey % 401 / 10.0::DOUBLE AS d, (p_partkey % 97)::DOUBLE AS ai FROM part)
SELECT p_partkey, {_SLOPE.format('tan(radians(d)) * 100')} AS slope, round(tan(radians(d)) * 100, 6) AS percent, {_SLOPE.format('tan(radians(greatest(d - 0.05, 0))) * 100')} <> {_SLOPE.format('tan(radians(d + 0.05)) * 100')} AS slope_unsure,
{_UNEP.format('ai / 100')} AS aridity, {_UNEP.format('(ai - 0.5) / 100')} <> {_UNEP.format('(ai + 0.5) / 100')} AS aridity_unsure FROM p""")
def y11s(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    both = t.part.select(k, statements.slope((k % 401 / 10).cast("double")).alias("s"), statements.aridity((k % 97).cast("double")).alias("a"))
    return rounded(both.select(k, F.col("s.name").alias("slope"), F.col("s.percent").alias("percent"), F.col("s.unsure").alias("slope_unsure"), F.col("a.name").alias("aridity"), F.col("a.unsure").alias("aridity_unsure")))


@query("Q_number_words", "SELECT o_orderkey, CASE WHEN n BETWEEN 0 AND 10 THEN ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'][n + 1] ELSE format('{:,}', n) END AS words FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_orderkey % 12 END AS n FROM orders)")
def q_words(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(k, scalars.number_word(F.when(k % 3 == 0, k).otherwise(k % 12)).alias("words"))


@query("Q_slugs", "SELECT p_partkey, replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ', '-') AS slug FROM part")
def q_slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", scalars.slug(F.col("p_name")).alias("slug"))
