"""Trait scans over customers, names, vectors and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import scalars
from terrane.operators import cluster, names, pairs, position, scan, weighted
from terrane.plans.curves import HAV, PLACED, SPACE, placed, space
from terrane.plans.registry import Tables, query, rounded

FEATURES = ["x", "y", "z"]
ZED = f"WITH {SPACE}, s AS (SELECT avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy, avg(z) mz, stddev_pop(z) sz FROM w), d AS (SELECT w.unit, c_mktsegment AS g, (x - mx) / sx AS x, (y - my) / sy AS y, (z - mz) / sz AS z FROM w JOIN customer ON c_custkey = w.unit, s)"


def _z(t: Tables) -> DataFrame:
    named = space(t).join(t.customer.select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("g")), "unit")
    return scan.backdrop(named, FEATURES)


@query("M13_cohesion_displacement", ZED + ", c AS (SELECT g, avg(x) cx, avg(y) cy, avg(z) cz, count(*) n FROM d GROUP BY 1) SELECT g, any_value(n) AS n, round(avg(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 6) AS cohesion, round(any_value(sqrt(cx * cx + cy * cy + cz * cz)), 6) AS displacement FROM d JOIN c USING (g) GROUP BY 1")
def m13(t: Tables) -> DataFrame:
    return rounded(scan.cohesion(_z(t), "g", FEATURES))


@query("M13_random_draw_null")
def m13r(t: Tables) -> DataFrame:
    return scan.random_draws(_z(t), "unit", FEATURES, 40, rounds=50)


@query("M15_top_families", """WITH f AS (SELECT c_mktsegment AS g, CASE WHEN c_custkey % 6 <> 0 THEN n_name END AS family FROM customer JOIN nation ON c_nationkey = n_nationkey), c AS (SELECT g, family, count(*) AS n FROM f GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY g, family IS NULL ORDER BY n DESC, family) AS r FROM c), k AS (SELECT g, n, CASE WHEN family IS NULL THEN 'unresolved' WHEN r <= 3 THEN 'family' ELSE 'other' END AS kind, family FROM r)
SELECT g, CASE WHEN kind = 'family' THEN family ELSE kind END AS label, kind, sum(n)::BIGINT AS n_rows, round(sum(n) / (sum(sum(n)) OVER (PARTITION BY g))::DOUBLE, 6) AS share FROM k GROUP BY g, label, kind""")
def m15(t: Tables) -> DataFrame:
    named = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("g"), F.when(F.col("c_custkey") % 6 != 0, F.col("n_name")).alias("family"))
    return rounded(scan.top_families(named, "g", "family"))


@query("M16_variable_percentiles", f"""WITH {SPACE}, m AS (SELECT avg(x) AS x, avg(y) AS y FROM f WHERE unit % 7 = 0), p AS (SELECT 'x' AS variable, (SELECT x FROM m) AS mean, 100 * avg((f.x <= m.x)::INT) AS pct FROM f, m UNION ALL SELECT 'y', (SELECT y FROM m), 100 * avg((f.y <= m.y)::INT) FROM f, m)
SELECT variable, round(mean, 6) AS mean, round(pct, 6) AS percentile, CASE WHEN pct >= 50 THEN 'high' ELSE 'low' END AS pole, CASE WHEN abs(pct - 50) >= 35 THEN 'very' WHEN abs(pct - 50) >= 15 THEN 'somewhat' ELSE 'typical' END AS qualifier FROM p""")
def m16(t: Tables) -> DataFrame:
    return rounded(scan.variable_percentiles(space(t), F.col("unit") % 7 == 0, {"x": ("low", "high"), "y": ("low", "high")}))


@query("Z1_isolates", f"""WITH {PLACED}, a AS (SELECT unit, lat, lon, c_nationkey AS family, unit % 13 = 0 AS h, (unit % 100)::DOUBLE AS p1, (unit % 37)::DOUBLE AS p2 FROM p JOIN customer ON c_custkey = unit), r AS (SELECT family, avg(h::INT) AS rarity FROM a GROUP BY 1), h AS (SELECT * FROM a WHERE h),
n AS (SELECT h.unit, min(CASE WHEN h.family <> o.family THEN {HAV.format(a='h', b='o')} END) AS km, min(sqrt((h.p1 - o.p1) ** 2 + (h.p2 - o.p2) ** 2)) AS env FROM h JOIN h o ON h.unit <> o.unit GROUP BY 1),
k AS (SELECT h.unit, rarity, km, env, rank() OVER (ORDER BY rarity) AS a, rank() OVER (ORDER BY round(km, 4) DESC NULLS LAST) AS b, rank() OVER (ORDER BY env DESC NULLS LAST) AS c FROM h LEFT JOIN r USING (family) LEFT JOIN n ON n.unit = h.unit)
SELECT unit, round(rarity, 4) AS rarity, round(km, 4) AS km, round(env, 4) AS environment, a AS rank_family, b AS rank_km, c AS rank_environment, greatest(a, b, c) AS worst_rank FROM k""")
def z1(t: Tables) -> DataFrame:
    df = placed(t).join(t.customer.select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("family")), "unit").withColumn("p1", (F.col("unit") % 100).cast("double")).withColumn("p2", (F.col("unit") % 37).cast("double"))
    return rounded(scan.isolates(df, "unit", "family", "lat", "lon", F.col("unit") % 13 == 0, ["p1", "p2"]), 4)


@query("L24_fuzzy_titles", """WITH a AS (SELECT p_partkey AS id, lower(p_name) AS n FROM part), b AS (SELECT p_partkey AS tid, CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) WHEN p_partkey % 3 = 1 THEN lower(p_name) || 'x' ELSE replace(lower(p_name), ' ', '') END AS t FROM part),
af AS (SELECT id, trim(regexp_replace(n, '[^a-z0-9]+', ' ', 'g')) AS n FROM a), bf AS (SELECT tid, trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) AS t FROM b),
da AS (SELECT DISTINCT n FROM af), db AS (SELECT min(tid) AS tid, t FROM bf GROUP BY t),
m AS (SELECT n, tid, 100.0::DOUBLE AS score, 'exact' AS how FROM da JOIN db ON n = t UNION ALL SELECT n, tid, 99.0, 'no space' FROM da JOIN db ON replace(n, ' ', '') = replace(t, ' ', '')
UNION ALL SELECT n, tid, s, 'fuzzy' FROM (SELECT n, tid, least(98.0, greatest(100 * (1 - levenshtein(n, t) / greatest(length(n), length(t))::DOUBLE), 100 * (1 - levenshtein(array_to_string(list_sort(string_split(n, ' ')), ' '), array_to_string(list_sort(string_split(t, ' ')), ' ')) / greatest(length(n), length(t))::DOUBLE))) AS s FROM da JOIN db ON list_has_any(string_split(n, ' '), string_split(t, ' '))) WHERE s >= 85)
SELECT DISTINCT ON (id) id, tid, round(score, 6) AS score, how FROM af JOIN m USING (n) ORDER BY id, score DESC, tid""")
def l24(t: Tables) -> DataFrame:
    some, k = t.part, F.col("p_partkey")
    lower = F.lower("p_name")
    title = F.when(k % 3 == 0, lower).when(k % 3 == 1, F.concat(lower, F.lit("x"))).otherwise(F.replace(lower, F.lit(" "), F.lit("")))
    return rounded(scan.fuzzy_matches(some.select(k.alias("id"), scalars.folded(lower).alias("n")), some.select(k.alias("tid"), scalars.folded(title).alias("t")), "n", "t", "id", "tid"))


@query("L24_title_matches")
def l24t(t: Tables) -> DataFrame:
    """Names of parts, a letter short in two thirds, matched with the types' words and the names of all parts."""
    name, k = scalars.folded(F.col("p_name")), F.col("p_partkey")
    asked = t.part.select(k.alias("id"), F.when(k % 3 == 0, name).when(k % 3 == 1, F.expr("substring(p_name, 2)")).otherwise(F.concat_ws(" ", name, scalars.folded(F.col("p_type")))).alias("n"))
    titles = t.part.select(k.alias("tid"), name.alias("t")).unionByName(t.part.select((k + 1_000_000_000).alias("tid"), scalars.folded(F.col("p_type")).alias("t")))
    return names.title_matches(asked, titles, "n", "t", "id", "tid")


@query("L25_name_agreement", "SELECT p_partkey, list_has_any(string_split(lower(p_name), ' '), string_split(lower(p_type), ' ')) AS agrees FROM part")
def l25(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", scan.name_agreement(F.lower("p_name"), F.lower("p_type")).alias("agrees"))


@query("L16_pca")
def l16(t: Tables) -> DataFrame:
    return cluster.pca(t.embeddings, "vec_id", "embedding", 3)


@query("L17_kmeans")
def l17(t: Tables) -> DataFrame:
    return cluster.kmeans(t.embeddings, "vec_id", "embedding", 5, seed=1)


@query("L20_k_selection")
def l20(t: Tables) -> DataFrame:
    return cluster.k_selection(t.embeddings, "vec_id", "embedding", [3, 5], seed=1)


@query("L21_cluster_agreement", """WITH l AS (SELECT vec_id % 4 AS a, label AS b FROM embeddings), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS x, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS y, (SELECT sum(n) FROM c) AS t)
SELECT round((i - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 8) AS ari FROM s""")
def l21(t: Tables) -> DataFrame:
    return cluster.agreement(t.embeddings.select((F.col("vec_id") % 4).alias("a"), F.col("label").alias("b")), "a", "b").select(F.round("ari", 8).alias("ari"))


#: A value for most nations and each segment, priority and status: averages over customers and orders.
SIGNED = """v AS (SELECT c_nationkey AS unit, 'segment ' || c_mktsegment AS variable, avg(c_acctbal) AS value FROM customer GROUP BY 1, 2
UNION ALL SELECT c_nationkey, 'priority ' || o_orderpriority, avg(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
UNION ALL SELECT c_nationkey, 'status ' || o_orderstatus, avg(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 4 <> 1 GROUP BY 1, 2),
st AS (SELECT variable, avg(value) AS m, stddev_pop(value) AS s FROM v GROUP BY 1), z AS (SELECT unit, variable, (value - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS z FROM v JOIN st USING (variable)),
un AS (SELECT DISTINCT unit FROM v), fl AS (SELECT unit, variable, coalesce(z, 0) AS z FROM un CROSS JOIN st LEFT JOIN z USING (unit, variable))"""
_PAIR = "SELECT a.unit AS a, b.unit AS b, count(*) AS n_common, sqrt(sum((a.z - b.z) ** 2)) AS euclidean, 1 - sum(a.z * b.z) / (sqrt(sum(a.z ** 2)) * sqrt(sum(b.z ** 2))) AS cosine FROM {z} a JOIN {z} b ON a.variable = b.variable AND a.unit < b.unit GROUP BY 1, 2"


def _signed(t: Tables) -> DataFrame:
    priced = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    mean = lambda df, name, by, value: df.groupBy(F.col("c_nationkey").alias("unit"), F.concat(F.lit(name), by).alias("variable")).agg(F.avg(value).alias("value"))
    return mean(t.customer, "segment ", F.col("c_mktsegment"), "c_acctbal").unionByName(mean(priced, "priority ", F.col("o_orderpriority"), "o_totalprice")).unionByName(mean(priced.where("c_nationkey % 4 <> 1"), "status ", F.col("o_orderstatus"), "o_totalprice"))


@query("L26_signature_distances", f"WITH {SIGNED} SELECT a, b, n_common, round(euclidean, 6) AS euclidean, round(cosine, 6) AS cosine FROM ({_PAIR.format(z='fl')})")
def l26(t: Tables) -> DataFrame:
    return rounded(pairs.distance_matrix(_signed(t), "unit", "variable", "value"))


@query("L26_common_distances", f"WITH {SIGNED} SELECT a, b, n_common, round(euclidean, 6) AS euclidean, round(cosine, 6) AS cosine FROM ({_PAIR.format(z='z')})")
def l26c(t: Tables) -> DataFrame:
    return rounded(pairs.distance_matrix(_signed(t), "unit", "variable", "value", imputed=False))


@query("L26_ranked_pairs", f"""WITH {SIGNED}, m AS ({_PAIR.format(z='fl')}), r AS (SELECT a, b, round(cosine, 12) AS d FROM m), o AS (SELECT *, row_number() OVER (ORDER BY d, a, b) AS s, row_number() OVER (ORDER BY d DESC, a, b) AS f FROM r)
SELECT 'similar' AS kind, s::INTEGER AS place, a, b, round(d, 6) AS distance FROM o WHERE s <= 5 UNION ALL SELECT 'different', f::INTEGER, a, b, round(d, 6) FROM o WHERE f <= 5""")
def l26r(t: Tables) -> DataFrame:
    return rounded(pairs.ranked_pairs(pairs.distance_matrix(_signed(t), "unit", "variable", "value"), "cosine", 5))


@query("M18_uniform_baseline")
def m18(t: Tables) -> DataFrame:
    """How much narrower the balances of a nation's customers lie, in percentiles, than as many even draws."""
    scored = position.percent_rank(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal").withColumn("_w", F.lit(1.0))
    c = weighted.cumulated(scored, ["c_nationkey"], "c_custkey", "score", "_w")
    q = weighted.midpoint_quantiles(c, ["c_nationkey"], "score", {"p10": 0.1, "p90": 0.9})
    k = scored.groupBy("c_nationkey").agg(F.count("score").alias("k"))
    return pairs.against_uniform(q.join(k, "c_nationkey").select("c_nationkey", "k", (F.col("p90") - F.col("p10")).alias("width")), "width")


#: Customers with a trait that most are coded for, a family that most belong to, and three variables of which one has gaps.
CODED = f"""{PLACED}, d AS (SELECT p.unit, lat, lon, CASE WHEN p.unit % 6 <> 0 THEN c_mktsegment END AS trait, CASE WHEN p.unit % 11 <> 0 THEN c_nationkey END AS family, c_acctbal AS x, (p.unit * 37 % 101)::DOUBLE AS y, CASE WHEN p.unit % 5 <> 0 THEN (p.unit * 13 % 57)::DOUBLE END AS z FROM p JOIN customer ON c_custkey = p.unit),
l AS (SELECT unit, unnest(['x', 'y', 'z']) AS variable, unnest([x, y, z]) AS v FROM d), k AS (SELECT *, rank() OVER (PARTITION BY variable ORDER BY v) AS lo, count(*) OVER (PARTITION BY variable, v) AS eq, count(*) OVER (PARTITION BY variable) AS n FROM l WHERE v IS NOT NULL),
pc AS (SELECT unit, variable, round(100.0 * (lo + (eq - 1) / 2.0) / n, 6) AS percentile FROM k)"""


def _coded(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    own = t.customer.select(k.alias("unit"), F.when(k % 6 != 0, F.col("c_mktsegment")).alias("trait"), F.when(k % 11 != 0, F.col("c_nationkey")).alias("family"), F.col("c_acctbal").alias("x"), (k * 37 % 101).cast("double").alias("y"), F.when(k % 5 != 0, (k * 13 % 57).cast("double")).alias("z"))
    return placed(t).select("unit", "lat", "lon").join(own, "unit")


def _focus() -> Column:
    return F.col("trait") == "BUILDING"


@query("M17_ticks", f"WITH {CODED} SELECT unit, family, variable, percentile FROM pc JOIN d USING (unit) WHERE trait = 'BUILDING'")
def m17t(t: Tables) -> DataFrame:
    return rounded(scan.ticks(_coded(t), "unit", "family", _focus(), FEATURES))


@query("M17_records", f"""WITH {CODED}, f AS (SELECT family, count(*) AS n FROM d WHERE trait IS NOT NULL AND family IS NOT NULL GROUP BY 1), w AS (SELECT unit, max(percentile) FILTER (WHERE variable = 'x') AS p_x, max(percentile) FILTER (WHERE variable = 'y') AS p_y, max(percentile) FILTER (WHERE variable = 'z') AS p_z FROM pc GROUP BY 1)
SELECT unit, round(lat, 6) AS lat, round(lon, 6) AS lon, family, CASE WHEN family IS NOT NULL THEN coalesce(f.n, 0) END AS family_coded, p_x, p_y, p_z FROM d LEFT JOIN f USING (family) LEFT JOIN w USING (unit) WHERE trait = 'BUILDING'""")
def m17r(t: Tables) -> DataFrame:
    return rounded(scan.records(_coded(t), "unit", "family", "trait", _focus(), FEATURES, ["lat", "lon"]))


@query("M17_scatter", f"WITH {CODED} SELECT unit, x, z AS y, CASE WHEN coalesce(trait = 'BUILDING', false) THEN 'focus' ELSE 'backdrop' END AS side FROM d WHERE x IS NOT NULL AND z IS NOT NULL")
def m17s(t: Tables) -> DataFrame:
    return scan.scatter(_coded(t), "unit", _focus(), "x", "z")


LENSES = {"wide": ["x", "y", "z"], "narrow": ["x", "y"]}


def _lens_sql(name: str, features: list[str]) -> tuple[str, str]:
    """Observed row and distances of one lens, over the rows with all its features."""
    whole = " AND ".join(f"{f} IS NOT NULL" for f in features)
    stats = ", ".join(f"avg({f}) AS m{f}, stddev_pop({f}) AS s{f}" for f in features)
    z = f"SELECT unit, trait, {', '.join(f'({f} - m{f}) / s{f} AS {f}' for f in features)} FROM d, (SELECT {stats} FROM d WHERE {whole}) WHERE {whole}"
    centre = ", ".join(f"avg({f}) AS c{f}" for f in features)
    far = " + ".join(f"({f} - c{f}) ** 2" for f in features)
    out = " + ".join(f"c{f} ** 2" for f in features)
    focus = f"SELECT * FROM ({z}) WHERE trait = 'BUILDING'"
    rows = f"SELECT '{name}' AS lens, unit, sqrt({far}) AS distance, sqrt({out}) AS shift FROM ({focus}), (SELECT {centre} FROM ({focus}))"
    observed = f"SELECT '{name}' AS lens, (SELECT count(*) FROM ({z})) AS n_backdrop, count(*) AS n_focus, round(avg(distance), 6) AS cohesion, round(max(shift), 6) AS displacement FROM ({rows})"
    return observed, f"SELECT lens, unit, round(distance, 6) AS distance FROM ({rows})"


@query("M14_lens_observed", f"WITH {CODED} " + " UNION ALL ".join(_lens_sql(n, fs)[0] for n, fs in LENSES.items()))
def m14o(t: Tables) -> DataFrame:
    return rounded(scan.lens_observed(_coded(t), "unit", _focus(), LENSES))


@query("M14_lens_distances", f"WITH {CODED} " + " UNION ALL ".join(_lens_sql(n, fs)[1] for n, fs in LENSES.items()))
def m14d(t: Tables) -> DataFrame:
    return rounded(scan.lens_distances(_coded(t), "unit", _focus(), LENSES))


@query("M14_lens_scan")
def m14(t: Tables) -> DataFrame:
    return scan.lens_scan(_coded(t), "unit", _focus(), LENSES, rounds=50)
