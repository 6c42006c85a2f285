"""Cases worked out by hand from the operators' definitions, beside the queries' SQL twins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import scalars
from terrane.functions.scalars import NotAllowed, one_of
from terrane.operators import blocks, cluster, dispersion, entry, geometry, graph, lenses, lookup, position, series, shapes, spatialstats, statements, weighted


def cum(spark, scores, weights):
    rows = [(1, i, float(s), float(w)) for i, (s, w) in enumerate(zip(scores, weights, strict=True))]
    return weighted.cumulated(spark.createDataFrame(rows, "query_id long, unit_id long, score double, weight double"), ["query_id"], "unit_id", "score", "weight")


def test_modality_takes_the_widest_gap_that_passes(spark):
    r = dispersion.modality(cum(spark, [0, 50, 90], [0.05, 0.45, 0.50]), ["query_id"], "score").first()
    assert (r.modality, r.gap) == ("two_regime", 40) and r.low_weight == pytest.approx(0.5) and r.low_center == pytest.approx(45) and r.high_center == pytest.approx(90)
    r = dispersion.modality(cum(spark, [10, 11, 12, 13], [1, 1, 1, 1]), ["query_id"], "score").first()
    assert (r.modality, r.gap) == ("unimodal", None)
    assert dispersion.modality(cum(spark, [5, 5], [1, 1]), ["query_id"], "score").first().modality == "unimodal"


def test_pooled_rows_equal_cumulated_rows(spark):
    rng = random.Random(1)
    rows = [(k % 3, k, rng.choice([None, 1.0, 2.0, rng.random() * 100]), rng.choice([0.0, rng.random()])) for k in range(60)]
    df = spark.createDataFrame(rows, "query_id long, unit_id long, score double, weight double")
    args = (["query_id"], "unit_id", "score", "weight")
    names = ["query_id", "unit_id", "w", "cum", "next_value", "next_cum"]
    near = lambda d: {tuple(r)[:2]: [None if x is None else round(x, 9) for x in tuple(r)[2:]] for r in d.select(*names).collect()}
    pooled = weighted.pooled(df, *args)
    assert pooled.count() == 60 and near(pooled.where("w IS NOT NULL")) == near(weighted.cumulated(df, *args))
    ties = {r.query_id: r.t for r in pooled.groupBy("query_id").agg(F.max("tie").alias("t")).collect()}
    for q in range(3):
        own = [(s, w) for k, _, s, w in rows if k == q and s is not None and w > 0]
        assert ties[q] == pytest.approx(max(sum(w for s, w in own if s == x) for x, _ in own) / sum(w for _, w in own))


def test_events_count_within_the_span_only(spark):
    q = spark.createDataFrame([(1, 100, 200), (2, 150, 160), (3, 1880, 1995)], "k long, lo long, hi long")
    e = spark.createDataFrame([(90, 30.0), (120, 12.0), (170, 6.0), (180, 4.0), (1950, 50.0)], "year long, size double")
    got = {r.k: (r.n_events, r.total, r.years_since_major) for r in series.event_summary(q, e, "k", "lo", "hi", "year", "size").collect()}
    assert got == {1: (2, 18.0, 80), 2: (0, 0.0, None), 3: (0, 0.0, None)}  # the catalogue ends in 1890


def test_ring_needs_three_neighbours_and_a_difference(spark):
    rows = [(1, 5.0, v) for v in (1.0, 2.0)] + [(2, 5.0, 5.0)] * 4 + [(3, 5.0, v) for v in (1.0, 2.0, 3.0, 4.0, 9.0)] + [(4, 5.0, v) for v in (1.0, 2.0, 9.0)] + [(5, 5.0, v) for v in (1.0, 2.0, 3.0, None)] + [(6, None, 1.0)] * 3
    got = {r.c: (r.n, r.side, r.k, r.top, r.all_but_one) for r in graph.ring_comparison(spark.createDataFrame(rows, "c long, a double, b double"), "c", "a", "b").collect()}
    assert got == {3: (5, "more", 4, False, True), 4: (3, "more", 2, False, False), 5: (3, "more", 3, True, False)}


def test_transitions_by_variable(spark):
    rows = [(1, "v", 50.0, 30.0), (1, "v", 50.0, 45.0), (1, "w", 10.0, 30.0), (1, "w", 10.0, 5.0), (1, "u", 1.0, None)]
    got = {r.variable: (r.max_abs, r.mean_abs, r.n_sharp, r.sign_pattern) for r in graph.transitions(spark.createDataFrame(rows, "c long, variable string, a double, b double"), "c", "variable", "a", "b").collect()}
    assert got == {"v": (20.0, 12.5, 1, "all+"), "w": (20.0, 12.5, 1, "mixed")}


def test_ancestors_have_no_cap_and_no_cycle(spark):
    chain = spark.createDataFrame([(i, i + 1 if i < 100 else 0) for i in range(1, 101)], "node long, parent long")
    got = {(r.node, r.ancestor, r.depth) for r in graph.ancestors(chain, "node", "parent").collect()}
    assert got == {(i, j, j - i) for i in range(1, 101) for j in range(i + 1, 101)}
    for loop in ([(1, 2), (2, 3), (3, 1)], [(1, 1)]):
        with pytest.raises(ValueError):
            graph.ancestors(spark.createDataFrame(loop, "node long, parent long"), "node", "parent")


def test_mixture_counts_labelled_units(spark):
    rows = spark.createDataFrame([(1, 0.5, "a"), (1, 0.3, "a"), (1, 0.2, None), (2, 1.0, None)], "query_id long, weight double, label string")
    got = {r.query_id: (r.status, r.n_units, r.coherence) for r in blocks.class_mixture(rows).collect()}
    assert got == {1: ("ok", 2, "concentrated"), 2: ("no_data", 0, None)}


def test_water_provenance(spark):
    kinds = [(1, 0, 5.0, 9.0, 1.0, 1.0, 9e3, "endorheic"), (0, 1, 5.0, 9.0, 1.0, 1.0, 9e3, "coastal"), (0, 1, None, 1.0, 1.0, 1.0, 9e3, "uniform"), (0, 0, 5.0, 1.0, 1.6, 1.0, 9e3, "exogenous"),
             (0, 0, 5.0, 1.6, 1.0, 1.0, 4e2, "undetermined"), (0, 0, 5.0, None, None, None, None, "uniform"), (0, 0, 5.0, 1.0, 1.0, 1.2, 9e3, "local"), (0, 0, 5.0, 1.6, None, None, None, "exogenous")]
    df = spark.createDataFrame(kinds, "e int, c int, d double, p double, a double, t double, u double, want string")
    for r in df.withColumn("got", statements.water_provenance(*(F.col(x) for x in "ecdpatu"))).collect():
        assert r.got == r.want


def test_statement_rules(spark):
    rows = [("v", "area_weighted", "ok", 12, 40.0, 0.5, 0.9), ("w", "area_weighted", "ok", 1, 40.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "variable string, method string, status string, area_units long, representative_score double, weight_at_zero double, coverage double").withColumn("representative_raw", F.lit(7.5))
    got = {(r.variable, r.rule): (r.applies, r.reason, r.stat) for r in statements.evaluate(df, statements.position_rules(), ["variable"]).collect()}
    assert got["v", "POS-02"] == (True, None, 40.0) and got["v", "POS-01"] == (False, "multi_unit", None) and got["w", "POS-02"] == (False, "one_unit", None)
    assert got["w", "POS-01"] == (True, None, 40.0) and got["w", "POS-03"][2] == 7.5 and got["v", "POS-07"][1] == "method:area_weighted"
    assert got["v", "POS-06"][2] == pytest.approx(0.5 / 0.9)
    q = spark.createDataFrame([(1, "polity", 9, 0.02), (2, "buffer", 1, 0.001)], "query_id long, scope string, area_units long, shortfall double")
    got = {(r.query_id, r.rule): (r.applies, r.reason, r.stat) for r in statements.evaluate(q, statements.coverage_rules(), ["query_id"]).collect()}
    assert got[1, "COV-01"] == (True, None, 0.02) and got[2, "COV-01"] == (False, "below_floor", 0.001) and got[2, "COV-02"][2] == 1 and got[1, "COV-04"][1] == "no_field"


def test_rows_are_placed_without_one_task(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1.0, 2.0, rng.random()])) for i in range(500)]
    got = {r.i: r["rank"] for r in position.placed(spark.createDataFrame(rows, "i long, v double").repartition(3), [F.desc("v"), F.col("i")]).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


def test_permutations_deal_all_values(spark):
    values = spark.createDataFrame([(i, float(i)) for i in range(20)], "unit long, z double")
    rounds = {}
    for r in spatialstats.permuted(values, 3).collect():
        rounds.setdefault(r["round"], {})[r.unit] = r.z
    assert len(rounds) == 3 and all(sorted(x) == list(range(20)) and sorted(x.values()) == list(range(20)) for x in rounds.values())
    assert rounds[1] != rounds[2]


def haversine(a, b):
    (p, l), (q, m) = (tuple(map(math.radians, x)) for x in (a, b))  # noqa: E741
    return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((m - l) / 2) ** 2))


@pytest.mark.parametrize("km", [30.0, 900.0, 9000.0])
def test_points_within_a_distance(spark, km):
    """Near the poles, over the date line, and equal places."""
    rng = random.Random(int(km))
    at = lambda: (rng.choice([89.9, -89.9, 90.0, rng.uniform(-90, 90), 10.0]), rng.choice([180.0, -180.0, 179.95, -179.95, rng.uniform(-180, 180), 10.1]))
    q, p = ([(i, *at()) for i in range(60)] for _ in range(2))
    frames = [spark.createDataFrame(x, f"{n} long, lat double, lon double") for x, n in ((q, "q"), (p, "p"))]
    got = sorted((r.q, r.p) for r in geometry.within_km(*frames, "q", "p", km).collect())
    assert got == sorted((i, j) for i, *a in q for j, *b in p if haversine(a, b) <= km)
    near = {(r.q, r.place): r.p for r in geometry.nearest_points(*frames, "q", "p", 2, start_km=km).collect()}
    for i, *a in q:
        best = sorted((round(haversine(a, b), 9), j) for j, *b in p)[:2]
        assert haversine(a, p[near[i, 1]][1:]) == pytest.approx(best[0][0], abs=1e-6) and haversine(a, p[near[i, 2]][1:]) == pytest.approx(best[1][0], abs=1e-6)


def test_nearest_value_in_one_stream(spark):
    rng = random.Random(8)
    q = [(i, i % 2, rng.randrange(50)) for i in range(40)]
    p = [(100 + i, i % 2, rng.randrange(50)) for i in range(15)] + [(7, 0, 10), (6, 0, 10)]
    out = lookup.nearest_value(spark.createDataFrame(q, "i long, k long, v long"), spark.createDataFrame(p, "p long, k long, w long"), "k", "v", "w", "p", ["i"])
    assert {r.i: (r.away, r.p) for r in out.collect()} == {i: min((abs(v - w), x) for x, c, w in p if c == k) for i, k, v in q}


def test_principal_coordinates_are_classical_scaling(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3)) * [3, 2, 0.5]
    df = spark.createDataFrame([("g", i, *map(float, r)) for i, r in enumerate(x)], "g string, i long, a double, b double, c double")
    got = np.zeros((40, 2))
    for r in spatialstats.principal_coordinates(df, "g", "i", ["a", "b", "c"]).collect():
        got[r.i, r.axis - 1] = r.coordinate
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    j = np.eye(40) - 1 / 40
    value, vector = np.linalg.eigh(-0.5 * j @ d2 @ j)
    want = vector[:, ::-1][:, :2] * np.sqrt(value[::-1][:2])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-9)


def test_vector_learners(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 4)), rng.normal(size=(30, 4)) + 9])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>")
    y = np.array([r.coordinates for r in sorted(cluster.pca(df, "i", "v", 3).collect())])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert np.allclose(np.abs(y), np.abs(z @ np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :3]), atol=1e-6)
    labels = [r.cluster for r in sorted(cluster.kmeans(df, "i", "v", 2, 1).collect())]
    assert len(set(labels[:30])) == len(set(labels[30:])) == 1 and labels[0] != labels[-1]
    two = next(r for r in cluster.k_selection(df, "i", "v", [2, 3], 1).collect() if r.k == 2)
    within = sum(((h - h.mean(0)) ** 2).sum() for h in (x[:30], x[30:]))
    between = ((x - x.mean(0)) ** 2).sum() - within
    assert two.inertia == pytest.approx(within) and two.calinski == pytest.approx(between / (within / 58))


def test_entry_points(spark):
    sets = spark.createDataFrame([(1, 1, 0.5, 1.0), (1, 2, 0.3, 0.4), (1, 3, 0.1, 0.1), (2, 3, 1.0, 1.0)], "query_id long, unit_id long, weight double, inside double")
    got = {r.query_id: tuple(r)[1:] for r in entry.scope_of(sets).collect()}
    assert got == {1: (3, 0.1, 0.4, 0.1), 2: (1, 0.0, 0.0, 0.0)}
    crosswalk = spark.createDataFrame([("p", 1, 0.7), ("p", 2, 5e-5), ("q", 1, 1.0)], "polity string, unit_id long, weight double")
    asked = spark.createDataFrame([(9, "p"), (8, "none")], "query_id long, polity string")
    assert [(r.query_id, r.unit_id, r.place) for r in entry.resolve_crosswalk(asked, crosswalk).collect()] == [(9, 1, 1)]
    assert entry.resolve_crosswalk(asked, crosswalk, level=6).count() == 0


def test_allowed_values():
    assert one_of("a", ("a", "b"), "mode") == "a"
    with pytest.raises(NotAllowed, match="mode is 'c'"):
        one_of("c", ("a", "b"), "mode")


def test_buffer_overlap_is_a_spherical_cap(spark):
    """A large unit around a buffer holds all of it, and the buffer's area is that of the cap but for its corners."""
    corner = lambda x, y: (float(x), float(y))
    unit = spark.createDataFrame([(1, [corner(-40, -40), corner(40, -40), corner(40, 40), corner(-40, 40)])], "unit long, ring array<struct<x:double,y:double>>")
    area = spark.range(1).select(F.lit(5).alias("area"), geometry.circle(F.lit(10.0), F.lit(5.0), F.lit(500.0), 256).alias("ring"))
    r = shapes.overlap_weights(unit, area, "unit", "area").first()
    cap = 2 * math.pi * 6371.0088**2 * (1 - math.cos(500 / 6371.0088))
    assert r.weight == pytest.approx(1, abs=1e-6) and r.overlap_km2 == pytest.approx(cap, rel=2e-3)


def test_two_wave_fit_equals_a_plain_search(spark):
    """Least mean error, over the mean, of one-wave and two-wave curves over the whole grid, one curve at a time."""
    import math

    curves_ = [[10 + 8 * math.sin(2 * math.pi * (t - 3) / 12) for t in range(12)], [5 + 4 * math.sin(2 * math.pi * (t - 1) / 6) for t in range(12)], [3.0] * 12, [0, 0, 0, 90, 200, 40, 0, 0, 5, 0, 0, 0]]
    df = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(curves_)] + [(9, [1.0] * 11), (10, None), (11, [0.0] * 12)], "k int, c array<double>")
    got = {r.k: r.e for r in df.select("k", lenses.two_period_fit("c").alias("e")).collect()}
    for k, c in enumerate(curves_):
        mean = sum(c) / 12
        for period, found in ((12, got[k].e12), (6, got[k].e6)):
            best = math.inf
            for i in range(81):
                a = i * 0.05
                lift = -0.001 * a**4 + 0.026 * a**3 - 0.245 * a**2 + 0.2432 * a - 0.038 if a > 1 else 0
                for j in range(4 * period):
                    wave = [max(0.0, 1 + lift + a * math.sin(2 * math.pi * (t - j / 4) / period)) for t in range(12)]
                    best = min(best, sum(abs(w * mean - x) for w, x in zip(wave, c, strict=True)) / 12 / mean)
            assert found == pytest.approx(best)
    assert got[0].e12 < 0.02 < got[0].e6 and got[1].e6 < 0.02 < got[1].e12
    assert all(got[k].e12 is None or math.isnan(got[k].e12) for k in (9, 10, 11))


def test_classes_near_their_edges(spark):
    shares = spark.createDataFrame([(10.5, 20.25, 69.25), (1.0, 1.0, 1.0), (50.0, 50.0, 0.0), (33.4, 33.3, 33.3), (0.5, 0.5, 99.0), (None, 1.0, 2.0)], "a double, b double, c double")
    whole = [tuple(r.s) for r in shares.select(statements.whole_shares(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()]
    assert whole[:5] == [(10, 20, 70), (34, 33, 33), (50, 50, 0), (34, 33, 33), (0, 0, 100)] and whole[5] == (None, None, None)
    slopes = spark.createDataFrame([(0.0,), (0.55,), (0.6,), (0.3,), (31.0,), (None,)], "d double")
    got = [r.s for r in slopes.select(statements.slope(F.col("d")).alias("s")).collect()]
    assert [r.name for r in got] == ["level", "level", "very gently sloping", "level", "very steep", None]
    assert [r.unsure for r in got][1:4] == [True, True, False] and got[5].unsure is None
    soils = spark.createDataFrame([(90.0, 5.0, 5.0), (40.0, 40.0, 20.0), (10.0, 10.0, 10.0), (None, 1.0, 1.0)], "a double, b double, c double")
    names = [tuple(r.t) for r in soils.select(statements.texture(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()]
    assert names == [("sand", False), ("loam", False), (None, True), (None, None)]
    words = spark.createDataFrame([(0,), (10,), (11,), (1234567,), (-3,), (None,)], "n int")
    assert [r.w for r in words.select(scalars.number_word(F.col("n")).alias("w")).collect()] == ["zero", "ten", "11", "1,234,567", "-3", None]
