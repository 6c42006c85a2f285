"""Steps that must not grow with the square of a group, against plain forms on odd inputs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import lenses, lookup, position, spatialstats

ROUNDS = 19


@pytest.fixture(scope="module")
def near(spark):
    """Groups of one and more, units without a group, links within and across groups, twice and to itself; and the same as edges."""
    rng = np.random.default_rng(4)
    groups = [(i, None if i % 11 == 0 else int(rng.integers(5)) if i else 77) for i in range(40)] + [(90, 77), (91, 78)]
    links = [(int(a), int(b)) for a, b in rng.integers(0, 40, (30, 2))] + [(3, 3), (5, 6), (6, 5)]
    g = dict(groups)
    edges = {(a, b) for a in g for b in g if a != b and g[a] is not None and g[a] == g[b]} | {x for a, b in links if a != b for x in ((a, b), (b, a))}
    short = spatialstats.neighbours(spark.createDataFrame(groups, "unit long, g int"), spark.createDataFrame(links, "i long, j long"), "unit", "g")
    rows = spark.createDataFrame([(i, None if i % 9 == 0 else float(rng.normal()), float(rng.normal()), None if i % 7 == 3 else "abc"[i % 3]) for i in g], "unit long, x double, y double, label string")
    return short, spark.createDataFrame(sorted(edges), "i long, j long"), rows


def table(df):
    rows = [tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in df.collect()]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("bivariate", [False, True])
def test_neighbours_in_short_equal_their_edges(near, bivariate):
    short, edges, rows = near
    z, other = spatialstats.mean_imputed(rows, "unit", "x"), spatialstats.mean_imputed(rows, "unit", "y") if bivariate else None
    assert short.links.count() < edges.count()
    w, v = spatialstats.row_standardised(short), spatialstats.row_standardised(edges)
    for f in (lambda w: spatialstats.morans_i(z, w, other), lambda w: spatialstats.local_moran(z, w, other), lambda w: spatialstats.lisa(z, w, ROUNDS, other=other)):
        assert table(f(w)) == table(f(v))


def test_moran_permutation_and_classes_in_short(near):
    short, edges, rows = near
    z = spatialstats.mean_imputed(rows, "unit", "x")
    assert table(spatialstats.moran_p(z, spatialstats.row_standardised(short), ROUNDS)) == table(spatialstats.moran_p(z, spatialstats.row_standardised(edges), ROUNDS))
    for f in (spatialstats.join_counts, spatialstats.local_coherence):
        assert table(f(rows, short, "unit", "label")) == table(f(rows, edges, "unit", "label"))


def test_rounds_are_never_broadcast_and_runs_give_the_same_places(spark, tmp_path, monkeypatch):
    # a small file, whose rows times rounds the planner takes for small too
    spark.range(3000).select(F.col("id").alias("unit"), (F.col("id") % 4).alias("g"), (F.col("id") % 97).cast("double").alias("x")).write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    dealt = spatialstats._labels_dealt(points, "g", ["x"], "unit", 9, 0, None)
    wide = [s for s in dealt._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in s and re.search(r"\b_p#", s)]
    assert not wide
    one = table(dealt.groupBy("round", "g").agg(F.sum("x")))
    monkeypatch.setattr(spatialstats, "RUN_ROWS", 100)
    assert table(spatialstats._labels_dealt(points, "g", ["x"], "unit", 9, 0, None).groupBy("round", "g").agg(F.sum("x"))) == one
    counts = spatialstats._drawn(points.select("unit", F.lit(0).alias("_block")), 3, 0).groupBy("round").agg(F.count_distinct("_p"), F.min("_p"), F.max("_p"))
    assert table(counts) == [(r, 3000, 0, 2999) for r in (1, 2, 3)]


def test_diameter_of_any_number_of_points(spark, monkeypatch):
    """Beyond 2,000 points, in one place, in a crowd, over the date line and among opposite ones; few pairs compared."""
    rng = np.random.default_rng(6)

    def plain(v):
        la, lo = np.radians(np.array(v)).T
        x = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la[:, None]) * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
        return 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(1, x))).max()

    crowd = [tuple(map(float, v)) for v in rng.normal(scale=0.01, size=(2100, 2)) + [10, 20]]
    globe = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 2100), rng.uniform(-180, 180, 2100), strict=True)]
    monkeypatch.setattr(lenses, "DIAMETER_PAIRS", 2000)
    for v in (crowd, globe, [(1.0, 2.0)] * 2, [(0.0, 179.9), (0.0, -179.9), (1.0, 180.0)]):
        got = lenses.diameter_km(spark.createDataFrame(v, "a double, b double"), "a", "b").first()[0]
        assert got == pytest.approx(plain(v), abs=1e-6)
    assert lenses.diameter_km(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), "a", "b").first()[0] is None


def test_nearest_by_mahalanobis_without_all_pairs(spark):
    """Equals the ranks over all pairs, with ties, copies, outliers, a constant feature and fewer rows than asked for; the queries
    may be more than a broadcast takes."""
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(120, 3)) * [1, 30, 5], 1)
    v[:20], v[20] = v[0], [50, -900, 80]
    rows = [(i, *map(float, r), 4.0) for i, r in enumerate(v)] + [(500, None, 1.0, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "unit long, a double, b double, c double, d double")
    asked = spark.createDataFrame([(i,) for i in (0, 5, 19, 20, 33, 77, 119, 500, 999)], "query_id long")
    for features, some, k in ((["a", "b", "c"], df, 6), (["a", "b", "d"], df, 3), (["a", "c"], df.where("unit < 23 AND unit > 17"), 9)):
        want = lenses.nearest(lenses.mahalanobis(some, asked, features, "unit"), k, "unit")
        got = lenses.mahalanobis_nearest(some, asked, features, "unit", k)
        assert table(got.select("query_id", "rank", "unit", "distance")) == table(want.select("query_id", "rank", "unit", "distance"))


def test_tiers_meet_one_name_each(spark):
    asked = spark.createDataFrame([(1, 1, 1), (2, 1, 9), (3, 8, 2), (4, 8, 9), (5, None, 2)], "k long, a long, b long")
    names = spark.createDataFrame([(i, i % 3, i % 4) for i in range(200)] + [(900, None, 2)], "id long, na long, nb long")
    a, b = {"a": "na"}, {"b": "nb"}
    got = lookup.tiered_match(asked, names, "k", [("exact", a | b), ("first", a), ("second", b)], "id")
    assert table(got) == [(1, "exact", 1), (2, "first", 1), (3, "second", 2), (5, "second", 2)]


def test_nearest_value_has_no_frame_to_the_end(spark):
    q = spark.createDataFrame([(i, 0, i * 0.5) for i in range(50)], "i long, k long, v double")
    p = spark.createDataFrame([(i, 0, i * 3.0) for i in range(8)], "p long, k long, w double")
    out = lookup.nearest_value(q, p, "k", "v", "w", "p", ["i"])
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.i: r.p for r in out.collect()} == {i: min((abs(i * 0.5 - 3 * j), j) for j in range(8))[1] for i in range(50)}


def test_event_totals_are_exact(spark, tmp_path):
    from terrane import plans

    spark.sql("SELECT 9L AS n_nationkey").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(i, v) for i, v in enumerate([2.0**53, *[51.0] * 4])], "event_id long, value double").selectExpr("event_id", "value", "'error' AS event_type", "timestamp'2024-01-13 00:00:00' AS ts").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert [(r.n_events, r.total) for r in plans.QUERIES["T4_event_summary"](plans.Tables(spark, str(tmp_path))).collect()] == [(5, float(2**53 + 204))]


def test_the_last_half_second_of_a_day_is_the_next_day(spark, tmp_path):
    from terrane import plans
    from tests.oracle import both, connect

    spark.range(25).withColumnRenamed("id", "n_nationkey").write.parquet(str(tmp_path / "nation.parquet"))
    times = [f"2024-01-{day:02d} {at}" for day in (3, 9, 14, 26) for at in ("00:00:00", "12:00:00.5", "23:59:58.5", "23:59:59.499999", "23:59:59.5", "23:59:59.9")]
    spark.createDataFrame([(i, at, 50.0 + i) for i, at in enumerate(times)], "event_id long, at string, value double").selectExpr("event_id", "value * 2 AS value", "'error' AS event_type", "CAST(at AS timestamp_ntz) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    duck = connect("/root/testdata/sf0.001")
    for t in ("nation", "events"):
        duck.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("T4_event_summary", "B7c_event_rows"):
        ours, theirs = both(plans.QUERIES[name](plans.Tables(spark, str(tmp_path))), duck, plans.SQL[name])
        assert ours == theirs


def test_like_queries_of_a_lens_follow_each_other(spark):
    from itertools import groupby

    from terrane.operators import lenses

    units = spark.createDataFrame([(i, float(i % 5), float(i % 5) ** 2) for i in range(200)], "unit long, x double, y double")
    got = lenses.euclidean(units, units.where("unit < 100").selectExpr("unit AS query_id"), ["x", "y"], "unit").collect()
    assert len(got) == 100 * 199
    for _, rows in groupby(got, key=lambda r: r.unit):
        assert len(list(groupby(rows, key=lambda r: r.distance))) <= 5


def test_crowds_in_one_place_make_no_pairs(spark, monkeypatch):
    from terrane.operators import geometry

    met, plain = [], geometry.meet

    def counted(q, p, km):
        met.append((q.count(), p.count()))
        return plain(q, p, km)

    monkeypatch.setattr(geometry, "meet", counted)
    q = spark.createDataFrame([(i, 10.0, 20.0 + i % 2) for i in range(60)], "q long, lat double, lon double")
    p = spark.createDataFrame([(i, 10.0, 20.0 + i % 3) for i in range(90)], "p long, lat double, lon double")
    got = geometry.nearest_points(q, p, "q", "p", 2)
    assert {(r.q, r.place): r.p for r in got.collect()} == {(i, k + 1): i % 2 + 3 * k for i in range(60) for k in (0, 1)}
    assert geometry.within_km(q, p, "q", "p", 1.0).count() == 60 * 30
    assert met == [(2, 6), (2, 3)]


def test_both_ways_reads_pairs_once(spark):
    out = lookup.both_ways(spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.7)], "a long, b long, d double"), "a", "b", ["d"])
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert table(out.select("node", "neighbour", "d")) == [(1, 2, 0.5), (2, 1, 0.5), (2, 3, 0.7), (3, 2, 0.7)]


def test_quantiles_by_ranks(spark):
    rng = np.random.default_rng(1)
    v = [("a", float(x)) for x in np.round(rng.normal(size=500), 1)] + [("b", 3.0), ("c", None)] + [("d", x) for x in (1.0, 2.0)]
    got = {r.k: r for r in position.quantiles(spark.createDataFrame(v, "k string, x double"), ["k"], "x", {"p": 0.1, "m": 0.5}).collect()}
    for k in "abd":
        x = [b for a, b in v if a == k]
        assert got[k].p == pytest.approx(np.quantile(x, 0.1)) and got[k].m == pytest.approx(np.quantile(x, 0.5))
    assert got["c"].p is None and len(got) == 4


def test_places_at_one_point_are_asked_once(spark, monkeypatch):
    from terrane.operators import outlines

    asked, plain = [], outlines.nearest_outline
    monkeypatch.setattr(outlines, "nearest_outline", lambda q, *a, **k: (asked.append(q.count()), plain(q, *a, **k))[1])
    ring = lambda x: f"array(named_struct('x', {x}D, 'y', 0D), named_struct('x', {x + 1}D, 'y', 0D), named_struct('x', {x + 1}D, 'y', 1D), named_struct('x', {x}D, 'y', 1D))"
    units, coast = (spark.sql(f"SELECT 1 AS {k}, {ring(x)} AS ring") for k, x in (("unit", 0.0), ("area", 2.0)))
    places = spark.createDataFrame([(i, 1, 0.5, 0.8 if i % 2 else 0.2) for i in range(30)], "place int, unit int, lat double, lon double")
    got = outlines.coast_distances(places, units, coast, "place", "unit", "area", 500.0).collect()
    assert asked == [2] and len({r.place for r in got}) == 30
    assert {r.place % 2: r.edge_km for r in got} == {0: pytest.approx(222.38, abs=0.1), 1: pytest.approx(111.19, abs=0.1)}


def test_even_draws_are_spread_over_tasks(spark):
    from terrane.operators import pairs

    drawn = pairs.uniform_widths(spark.createDataFrame([(7,), (900,)], "k long"), 200)
    assert "array_sort" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    assert drawn.select(F.spark_partition_id().alias("p")).distinct().count() == 4
