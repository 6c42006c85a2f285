"""Small frames with values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from terrane.functions import curves, scalars
from terrane.operators import blocks, dispersion, geometry, lookup, position, scan, shapes, spatialstats, weighted
from terrane.sources import files
from terrane.streaming import log


def frame(spark, scores, weights):
    return spark.createDataFrame([("q", i, "v", float(w), None if s is None else float(s)) for i, (s, w) in enumerate(zip(scores, weights, strict=True))], "query_id string, unit_id long, variable string, weight double, score double")


def cum(spark, scores, weights):
    return weighted.cumulated(frame(spark, scores, weights), ["query_id"], "unit_id", "score", "weight")


def test_weighted_quantiles(spark):
    c = cum(spark, [0, 10, 20], [0.2, 0.3, 0.5])
    r = weighted.quantiles(c, ["query_id"], "score", {"a": 0.1, "b": 0.35, "c": 0.75}).first()
    assert (r.a, round(r.b, 9), round(r.c, 9)) == (0, 5, 15)
    m = weighted.midpoint_quantiles(c, ["query_id"], "score", {"a": 0.1, "b": 0.35, "c": 0.225}).first()
    assert [round(x, 9) for x in (m.a, m.b, m.c)] == [0, 10, 5]


def test_floor_percentile(spark):
    a = F.array(*map(F.lit, range(1, 11)))
    assert spark.range(1).select(weighted.floor_percentile(a, 0.25)).first()[0] == 3


@pytest.mark.parametrize(
    ("rank", "values", "expected"),
    [
        (position.percent_rank, [1, 2, 2, 5], [0, 33.3, 33.3, 100]),
        (position.average_rank, [1, 2, 2, 5], [0, 50, 50, 100]),
        (position.rank_share, [1, 2, 2, 5], [25, 62.5, 62.5, 100]),
        (position.zero_aware_rank, [0, 0, 1, 2, 3], [0, 0, 0, 50, 100]),
        (position.percent_rank, [4, None], [0, None]),
    ],
)
def test_ranks(spark, rank, values, expected):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "k long, x double")
    got = [r.score for r in rank(df, "x").orderBy("k").collect()]
    assert got == [None if e is None else pytest.approx(e, abs=0.05) for e in expected]


def test_ranks_dont_depend_on_ranges(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 91).cast("double").alias("x"))
    runs = [{r.id: r.score for r in position.percent_rank(df, "x", ranges=n).collect()} for n in (2, 7, 40)]
    assert runs[0] == runs[1] == runs[2]


def test_core_share_and_split(spark):
    rows = weighted.pooled(frame(spark, [10, 20, 60], [0.5, 0.2, 0.3]), ["query_id"], "unit_id", "score", "weight")
    r = dispersion.dispersion(rows, ["query_id"], "score", fewest=1).first()
    assert (round(r.core_share, 9), r.window_lo, r.window_hi, round(r.tie, 9), r.coherence) == (0.7, 0, 30, 0.5, "split")
    assert dispersion.dispersion(rows, ["query_id"], "score").first().coherence is None


def test_two_regimes(spark):
    r = dispersion.modality(cum(spark, [0, 0, 100, 100], [1, 1, 1, 1]), ["query_id"], "score").first()
    assert (r.modality, r.gap, r.low_weight, r.low_center, r.high_center) == ("two_regime", 100, 0.5, 0, 100)


def test_class_mixture_and_outlets(spark):
    rows = spark.createDataFrame([("q", 1, 0.5, "A"), ("q", 2, 0.3, "B"), ("q", 3, 0.2, "C")], "query_id string, unit_id long, weight double, label string")
    r = blocks.class_mixture(rows).first()
    assert (r.modal_class, r.modal_share, round(r.concentration, 9), r.coherence, r.status) == ("A", 0.5, 0.38, "mixed", "ok")
    flags = rows.select("query_id", "weight", F.lit(1).alias("endo"), F.lit(1).alias("coast"))
    with pytest.raises(Exception, match="coastal"):
        blocks.outlet_types(flags, "endo", "coast").collect()


def test_no_data_and_outside_domain(spark):
    r = blocks.area_weighted(frame(spark, [None, None], [0.5, 0.5])).first()
    assert (r.status, r.n_units, r.representative_score) == ("no_data", 0, None)
    dry = frame(spark, [0, 0, 80], [0.5, 0.45, 0.05]).withColumn("zf", F.lit(0.6))
    assert blocks.area_weighted(dry, zero_fraction="zf").first().status == "outside_active_domain"


def test_circle_statistics(spark):
    one, flat = F.array(*(F.lit(float(i == 3)) for i in range(12))), F.array(*(F.lit(1.0) for _ in range(12)))
    r = spark.range(1).select(curves.concentration(one).alias("a"), curves.concentration(flat).alias("b"), curves.peak_month(one).alias("c"), curves.centred_unit(flat).alias("d"), curves.pearson(one, flat).alias("e")).first()
    assert r.a == pytest.approx(1) and r.b == pytest.approx(0, abs=1e-12) and r.c == pytest.approx(3) and r.d is None and r.e is None


def test_sentinels_before_scaling(spark):
    df = spark.createDataFrame([(-9999.0,), (120.0,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(scalars.descaled(F.col("x"), "tmp_dc_syr")).collect()] == [None, 12.0, None, None]


def test_islands(spark):
    df = spark.createDataFrame([("p", i, h) for i, h in enumerate("aabba")], "p string, y int, h string")
    assert [r.island for r in lookup.islands(df, "p", ["y"], "h").orderBy("y").collect()] == [1, 1, 2, 2, 3]


def test_floor_lookup_keeps_unmatched(spark):
    q = spark.createDataFrame([("a", 5), ("a", 0), ("b", 9)], "k string, at int")
    s = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y")], "k string, step int, v string")
    assert sorted((r.k, r.at, r.v) for r in lookup.floor_lookup(q, s, "at", "step", "k", ["v"]).collect()) == [("a", 0, None), ("a", 5, "y"), ("b", 9, None)]


def test_geometry_areas(spark):
    sq = lambda x, y, d: F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((x, y), (x + d, y), (x + d, y + d), (x, y + d))))
    units = spark.range(1).select(F.explode(F.array(F.struct(F.lit(1).alias("unit"), sq(0, 0, 10).alias("ring")), F.struct(F.lit(2).alias("unit"), sq(10, 0, 10).alias("ring")))).alias("s")).select("s.*")
    area = spark.range(1).select(F.lit(7).alias("area"), sq(5, 0, 10).alias("ring"))
    w = {r.unit: r for r in shapes.overlap_weights(units, area, "unit", "area").collect()}
    assert w[1].weight == pytest.approx(0.5) and w[2].weight == pytest.approx(0.5) and w[1].unit_fraction == pytest.approx(0.5)


def test_buffer_area(spark):
    big = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((-10, -10), (10, -10), (10, 10), (-10, 10))))
    unit = spark.range(1).select(F.lit(1).alias("unit"), big.alias("ring"))
    disc = spark.range(1).select(F.lit(1).alias("area"), geometry.circle(F.lit(0.0), F.lit(0.0), F.lit(300.0), 256).alias("ring"))
    assert shapes.overlap_weights(unit, disc, "unit", "area").first().overlap_km2 == pytest.approx(3.14159 * 300**2, rel=2e-3)


def test_permanova_equals_pairwise_distances(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(30, 2)), np.repeat([0, 1, 2], 10)
    x[g == 2] += 1
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    sst = d2.sum() / 2 / 30
    ssw = sum(d2[np.ix_(g == k, g == k)].sum() / 2 / 10 for k in range(3))
    df = spark.createDataFrame([(i, int(g[i]), float(a), float(b)) for i, (a, b) in enumerate(x)], "unit long, g int, x double, y double")
    r = spatialstats.pseudo_f(df, "g", ["x", "y"]).first()
    assert r.f == pytest.approx((sst - ssw) / 2 / (ssw / 27))
    p = spatialstats.permanova_p(df, "g", ["x", "y"], "unit", rounds=49).first()
    assert p.f == pytest.approx(r.f) and 0.02 <= p.p < 0.2


def test_moran_of_a_chain(spark):
    v = spark.createDataFrame([(i, float(i)) for i in range(6)], "unit long, x double")
    e = spark.createDataFrame([(i, j) for i in range(6) for j in (i - 1, i + 1) if 0 <= j < 6], "i long, j long")
    w, z = spatialstats.row_standardised(e), spatialstats.mean_imputed(v, "unit", "x")
    assert spatialstats.moran_p(z, w, 49).first().p <= 0.1
    assert {r.quadrant for r in spatialstats.local_moran(z, w).collect()} <= {"HH", "LL", "HL", "LH"}


def test_diff_treats_nan_as_null(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, float("nan"), "y")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.005, "x"), (2, None, "z")], "k int, v double, s string")
    assert [(r.k, r["column"]) for r in blocks.diff(a, b, ["k"]).collect()] == [(2, "s")]


def test_payload_lists_caveats_once(spark):
    rows = spark.createDataFrame([("q", "a", ["x"]), ("q", "b", ["x"])], "query_id string, variable string, caveat array<string>")
    doc = json.loads(blocks.payload(rows, "area", {"x": "text"}).first().payload)
    assert doc["caveats"] == [{"key": "x", "text": "text"}] and [r["variable"] for r in doc["rows"]] == ["a", "b"]


def test_fuzzy_titles(spark):
    a = spark.createDataFrame([(1, "Rio  Grande (north)"), (2, "Saô Paulo")], "id long, n string").withColumn("n", scalars.folded(F.col("n")))
    b = spark.createDataFrame([(7, "rio grande"), (8, "sao paulos")], "tid long, t string")
    assert {(r.id, r.tid, r.how) for r in scan.fuzzy_matches(a, b, "n", "t", "id", "tid").collect()} == {(1, 7, "exact"), (2, 8, "fuzzy")}


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tname\n1\tx\n\ty\n")
    assert [(r.id, r.name) for r in files.read_tsv(spark, str(tmp_path / "a.tsv"), "id long, name string").orderBy("name").collect()] == [(1, "x"), (None, "y")]
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"@id": "p1", "properties": {"title": "T"}, "geometry": {"type": "Point", "coordinates": [3, 4.5]}}, {"id": "p2", "properties": {}}]}))
    got = [(r.id, r.title, r.x, r.y) for r in files.read_features(spark, str(tmp_path / "f.json")).orderBy("feature_no").collect()]
    assert got == [("p1", "T", 3.0, 4.5), ("p2", None, None, None)]
    (tmp_path / "e.tab").write_text("/* DATA DESCRIPTION:\nx\n*/\nYear\tSO4\n-426\t59.4\n1257\t\n")
    e = files.numeric(files.read_event_table(spark, str(tmp_path / "e.tab"), ["year", "so4"]), "year", "so4")
    assert [tuple(r) for r in e.orderBy("year").collect()] == [(-426.0, 59.4), (1257.0, None)]
    (tmp_path / "h.txt").write_text("# Site_Name: Here\n# Elevation: unknown\n# Latitude: 12.5\n1 2\n")
    h = files.numeric(files.read_header_records(spark, str(tmp_path / "h.txt"), {"site": "Site_Name", "elev": "Elevation", "lat": "Latitude"}), "elev", "lat").first()
    assert (h.site, h.elev, h.lat) == ("Here", None, 12.5)


def test_resumable_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        files.insert_ignore(spark.createDataFrame(rows, "k int, v string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = log.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "event_type", "value")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("log_counts").start()
    q.processAllAvailable()
    q.stop()
    count = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert count(spark.table("log_counts")) == count(log.windowed_counts(events, "ts", "event_type", "value"))
