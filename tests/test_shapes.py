"""Areas of any form and their outlines, against grid counts, brute force and sizes known beforehand."""

import math
import random

import numpy as np
import pytest

from terrane.operators import graph, outlines, shapes

KM = 6371.0088
SHAPE = "k int, shape array<array<array<struct<x:double,y:double>>>>"


def star(rng, cx, cy, r, n, backwards=False):
    at = [(2 * math.pi * (k + rng.random()) / n, r * rng.uniform(0.55, 1)) for k in range(n)]
    points = [(cx + q * math.cos(t), cy + q * math.sin(t)) for t, q in at]
    return points[::-1] if backwards else points


def box(w, s, e, n):
    return [(float(w), float(s)), (float(e), float(s)), (float(e), float(n)), (float(w), float(n))]


def band(w, s, e, n):
    return math.radians(e - w) * (math.sin(math.radians(n)) - math.sin(math.radians(s))) * KM**2


def frame(spark, rows, name):
    return spark.createDataFrame(rows, SHAPE).withColumnRenamed("k", name)


def covers(x, y, shape):
    n = np.zeros(np.broadcast(x, y).shape, int)
    for part in shape:
        for r in part:
            for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
                if ay != by:
                    n += ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return n % 2 == 1


def test_overlaps_of_stars_with_holes_and_parts_equal_a_grid_count(spark):
    rng = random.Random(8)
    some = [(k, [[star(rng, 0, 10, 20, 12, k == 1), star(rng, 0, 10, 5, 6, k == 2)], [star(rng, 32, -20, 9, 9)]]) for k in range(3)]
    other = [(k, [[star(rng, 4, 5, 18, 14, k == 0), star(rng, 3, 6, 6, 5)], [star(rng, 30, -18, 8, 7, True)]]) for k in range(3)]
    got = {(r.a, r.b): r.km2 for r in shapes.overlaps(frame(spark, some, "a"), frame(spark, other, "b"), "a", "b").collect()}
    narrow = {(r.a, r.b): r.km2 for r in shapes.overlaps(frame(spark, some, "a"), frame(spark, other, "b"), "a", "b", column=0.5, row=2.0).collect()}
    assert narrow.keys() == got.keys() and all(narrow[k] == pytest.approx(v, rel=1e-9) for k, v in got.items())
    x, z = np.linspace(-30, 50, 1600, endpoint=False) + 0.025, np.linspace(-0.6, 0.6, 1600, endpoint=False) + 0.000375
    x, y = x[None, :], np.degrees(np.arcsin(z))[:, None]
    cell = math.radians(0.05) * 0.00075 * KM**2
    for i, p in some:
        for j, q in other:
            assert got[i, j] == pytest.approx((covers(x, y, p) & covers(x, y, q)).sum() * cell, rel=2e-3)


def test_units_that_tile_an_area_add_up_to_it(spark):
    rng = random.Random(4)
    area = frame(spark, [(1, [[star(rng, 5, 50, 14, 30), star(rng, 5, 50, 4, 8)]])], "area")
    units = frame(spark, [(10 * i + j, [[box(-30 + 8 * i, 20 + 7 * j, -22 + 8 * i, 27 + 7 * j)]]) for i in range(9) for j in range(9)], "unit")
    r = shapes.overlap_weights(units, area, "unit", "area").collect()
    assert sum(x.weight for x in r) == pytest.approx(1, abs=1e-12) and all(0 < x.unit_fraction <= 1 + 1e-12 for x in r)


def test_forms_that_are_not_convex(spark):
    arm = [(0.0, 0.0), (30.0, 0.0), (30.0, 10.0), (10.0, 10.0), (10.0, 40.0), (0.0, 40.0)]
    areas = frame(spark, [(1, [[arm]]), (2, [[box(0, 0, 40, 40), box(10, 10, 30, 30)]]), (3, [[box(170, -5, 190, 5)]]), (4, [[box(-180, 60, 180, 90)]]), (5, None), (6, [[box(0, 0, 1, 1)[:2]]]), (7, [])], "area")
    units = frame(spark, [(1, [[box(2, 20, 8, 30)]]), (2, [[box(12, 12, 28, 28)]]), (3, [[box(-180, 0, -175, 9)]]), (4, [[box(40, 0, 50, 40)]]), (5, [[[*box(5, 5, 20, 20), (5.0, 5.0)]]])], "unit")
    got = {(r.area, r.unit): r.overlap_km2 for r in shapes.overlap_weights(units, areas, "unit", "area").collect()}
    want = {(1, 1): band(2, 20, 8, 30), (2, 1): band(2, 20, 8, 30), (3, 3): band(0, 0, 5, 5), (1, 5): band(5, 5, 20, 10) + band(5, 10, 10, 20), (2, 5): band(5, 5, 20, 20) - band(10, 10, 20, 20)}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}
    sizes = {r.area: r.km2 for r in shapes.areas(areas, "area").collect()}
    assert sizes == {1: pytest.approx(band(0, 0, 30, 10) + band(0, 10, 10, 40)), 2: pytest.approx(band(0, 0, 40, 40) - band(10, 10, 30, 30)), 3: pytest.approx(band(0, -5, 20, 5)), 4: pytest.approx(band(0, 60, 360, 90))}


def test_region_shares(spark):
    units = spark.createDataFrame([(1, [[box(0, 0, 10, 10)]], 2), (2, [[box(50, 0, 60, 10)]], None)], "unit int, shape array<array<array<struct<x:double,y:double>>>>, own int")
    regions = frame(spark, [(1, [[box(0, 0, 5, 20)]]), (2, [[box(5, 0, 8, 20)]]), (3, [[box(8, 0, 9.5, 20)]]), (4, [[box(9.5, 0, 10, 20)]]), (5, [[box(10, 0, 20, 20)]])], "region")
    got = [(r.unit, r.region, round(r.share, 9), r.place, r.named) for r in shapes.region_shares(units, regions, "unit", "region").orderBy("place").collect()]
    assert got == [(1, 1, 0.5, 1, False), (1, 2, 0.3, 2, False), (1, 3, 0.15, 3, True), (1, 4, 0.05, 4, False)]


def arc_km(p, a, b):
    """Distance to an arc by a fine walk along it."""
    w = math.acos(max(-1, min(1, float(a @ b))))
    t = np.linspace(0, 1, 2001)[:, None]
    points = (np.sin(w * (1 - t)) * a + np.sin(w * t) * b) / math.sin(w)
    return KM * np.arctan2(np.linalg.norm(np.cross(points, p), axis=1), points @ p).min()


def unit(lat, lon):
    p, t = math.radians(lat), math.radians(lon)
    return np.array([math.cos(p) * math.cos(t), math.cos(p) * math.sin(t), math.sin(p)])


def test_distances_to_outlines(spark):
    rng = random.Random(6)
    rings = [box(170, -20, 200, 10), box(-170, 70, -100, 85), box(0, -89, 120, -80), star(rng, 20, 30, 12, 9), star(rng, 21, 31, 3, 5), box(60, 0, 61, 1)]
    polygons = frame(spark, [(k, [[r]]) for k, r in enumerate(rings)], "k")
    asked = [(0, 0.0, 179.0, 0), (1, 90.0, 5.0, None), (2, -90.0, 50.0, 2), (3, 30.0, 20.5, 4), (4, 0.5, -179.9, 9), (5, 88.0, 60.0, 1)] + [(6 + k, rng.uniform(-90, 90), rng.uniform(-180, 180), rng.randrange(6)) for k in range(40)]
    queries = spark.createDataFrame(asked, "q int, lat double, lon double, own int")
    arcs = {k: [(unit(ay, ax), unit(by, bx)) for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True)] for k, r in enumerate(rings)}
    far = {(q, k): min(arc_km(unit(la, lo), a, b) for a, b in arcs[k]) for q, la, lo, _ in asked for k in arcs}
    for own, start in ((None, 100.0), ("own", 3000.0)):
        got = {r.q: r for r in outlines.nearest_outline(queries, polygons, "q", "k", own, start_km=start).collect()}
        assert len(got) == len(asked)
        for q, la, lo, o in asked:
            want = min(far[q, k] for k in arcs if own is None or k != o)
            assert got[q].km == pytest.approx(want, abs=0.05) and far[q, got[q].k] == pytest.approx(want, abs=0.05)
            assert KM * math.acos(max(-1, min(1, float(unit(la, lo) @ unit(got[q].lat, got[q].lon))))) == pytest.approx(got[q].km, abs=0.2)
    some = {r.q for r in outlines.nearest_outline(queries, polygons, "q", "k", most_km=500.0).collect()}
    assert some == {q for q, *_ in asked if min(far[q, k] for k in arcs) <= 500}
    over = {r.q: (r.k, r.km) for r in outlines.nearest_polygon(queries, polygons, "q", "k", own="own").collect()}
    assert over[3] == (3, 0.0) and over[0][1] > 0  # its own polygon is left out, the one around it covers it


def test_gaps_between_outlines(spark):
    polygons = frame(spark, [(1, [[box(0, 0, 1, 1)]]), (2, [[box(0.5, 0.5, 3, 3)]]), (3, [[box(178, 10, 179.5, 11)]]), (4, [[box(100, -50, 101, -49)]])], "u")
    coast = frame(spark, [(7, [[box(2, -1, 4, 2)]]), (8, [[box(-179.5, 10.2, -178, 10.4)]])], "c")
    got = {r.u: (r.c, r.km) for r in outlines.outline_gaps(polygons, coast, "u", "c", start_km=20.0, most_km=1500.0).collect()}
    assert got == {1: (7, pytest.approx(111.195, abs=0.05)), 2: (7, 0.0), 3: (8, pytest.approx(math.radians(1) * KM * math.cos(math.radians(10.4)), rel=1e-3))}
    places = spark.createDataFrame([(1, 1, 0.5, 0.9), (2, 1, 0.5, 0.1), (3, 4, -49.5, 100.5)], "p int, u int, lat double, lon double")
    coasts = {r.p: (r.outline_km, r.edge_km) for r in outlines.coast_distances(places, polygons, coast, "p", "u", "c", near_km=500.0).collect()}
    assert coasts == {1: (pytest.approx(111.19, abs=0.05), pytest.approx(111.19, abs=0.05)), 2: (pytest.approx(111.19, abs=0.05), pytest.approx(222.39, abs=0.1)), 3: (None, None)}


def test_outline_lengths(spark):
    polygons = frame(spark, [(1, [[box(0, 0, 10, 10)]]), (2, [[box(0, 0, 10, 10), box(2, 2, 3, 3)]])], "u")
    r = {x.u: x.km for x in outlines.lengths(polygons, "u").collect()}
    degree = math.radians(1) * KM
    assert r[1] == pytest.approx(30 * degree + 2 * KM * math.asin(math.sin(math.radians(5)) * math.cos(math.radians(10)))) and r[2] > r[1] + 3.9 * degree


@pytest.mark.parametrize("cell", [0.7, 5.0])
def test_shared_borders(spark, cell):
    slanted = [(0.0, 3.5), (-4.0, 3.5), (-4.0, 0.0), (3.5, 0.0)]
    polygons = {1: box(0, 5, 10, 15), 2: box(10, 8, 20, 20), 3: box(10, 5, 20, 8), 4: box(20, 20, 30, 30), 5: slanted, 6: [(3.5, 0.0), (1.2, 2.3), (6.0, 2.3)], 7: box(-180, 50, -170, 60), 8: box(170, 55, 180, 70), 9: box(60, 60, 61, 61)}
    got = {(r.i, r.j): r for r in outlines.touching(frame(spark, [(k, [[r]]) for k, r in polygons.items()], "k"), "k", cell=cell).collect()}
    degree = math.radians(1) * KM
    want = {(1, 2): (7 * degree, 11.5, 10.0), (1, 3): (3 * degree, 6.5, 10.0), (2, 3): (2 * KM * math.asin(math.sin(math.radians(5)) * math.cos(math.radians(8))), 8.0, 15.0), (2, 4): (0.0, 20.0, 20.0), (7, 8): (5 * degree, 57.5, -180.0), (5, 6): (2 * KM * math.asin(math.sqrt(math.sin(math.radians(1.15)) ** 2 + math.cos(math.radians(2.3)) * math.sin(math.radians(1.15)) ** 2)), 1.15, 2.35)}
    assert got.keys() == {*want, *((j, i) for i, j in want)}
    for (i, j), (km, lat, lon) in want.items():
        for r in (got[i, j], got[j, i]):
            assert (r.shared_km, r.mid_lat, r.mid_lon) == (pytest.approx(km, rel=1e-6), pytest.approx(lat), pytest.approx(lon))


def test_catchments_sum_their_steps_and_stop(spark):
    rows = [(1, 0, 5.0, False), (2, 1, 1.5, False), (3, 2, 2.0, False), (4, 3, 4.0, True), (5, 4, 1.0, False), (6, 3, None, False), (7, 6, 1.0, False), (8, 4, 1.0, False)]
    links = spark.createDataFrame(rows, "n int, p int, km double, endo boolean")
    targets = spark.createDataFrame([(1,), (3,), (4,)], "target int")
    got = {(r.target, r.node): (r.depth, r.distance) for r in graph.catchments(links, targets, "n", "p", "km", "endo").collect()}
    assert got == {(1, 1): (0, 0.0), (1, 2): (1, 1.5), (1, 3): (2, 3.5), (1, 6): (3, None), (1, 7): (4, None), (3, 3): (0, 0.0), (3, 6): (1, None), (3, 7): (2, None)}
    chain = spark.range(1, 300).selectExpr("id AS n", "id - 1 AS p", "CAST(id AS DOUBLE) AS km")
    far = {(r.node, r.ancestor): (r.depth, r.distance) for r in graph.ancestors(chain, "n", "p", "km").collect()}
    assert len(far) == 299 * 298 // 2 and far[299, 1] == (298, sum(range(2, 300))) and far[20, 17] == (3, 18 + 19 + 20)


def test_centroids_points_on_the_surface_and_simpler_lines(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    bent = [(0.0, 0.0), (30.0, 0.0), (30.0, 2.0), (2.0, 2.0), (2.0, 30.0), (0.0, 30.0)]
    some = [(1, [[box(0, 0, 10, 10)]]), (2, [[bent]]), (3, [[box(0, 0, 40, 40), box(10, 10, 30, 30)]]), (4, [[star(rng, 5, 5, 9, 17, True)], [box(40, 0, 41, 1)]]), (5, None)]
    got = {r.k: r for r in shapes.centroids(frame(spark, some, "k"), "k").collect()}
    assert (got[1].x, got[1].y, got[1].square_degrees) == (5, 5, 100) and (got[3].x, got[3].square_degrees) == (pytest.approx(20), pytest.approx(1200))
    middle = pytest.approx((60 * 15 + 56 * 1) / 116)
    assert got[2].x == middle and got[2].y == middle and len(got) == 4
    on = {r.k: r.p for r in frame(spark, some, "k").select("k", shapes.point_on_surface(F.col("shape")).alias("p")).collect()}
    for k, shape in some[:4]:
        assert covers(np.array(on[k].x), np.array(on[k].y), shape)
    line = [(float(x), math.sin(x / 9)) for x in range(60)]
    ring = spark.createDataFrame([(1, line), (2, [(0.0, 0.0), (1.0, 0.001), (2.0, 0.0)]), (3, line[:2]), (4, None)], "k int, r array<struct<x:double,y:double>>")
    left = {r.k: r.s for r in ring.select("k", shapes.simplified("r", F.lit(0.01)).alias("s")).collect()}
    assert [tuple(p) for p in left[2]] == [(0, 0), (2, 0)] and len(left[3]) == 2 and left[4] is None
    points = [tuple(p) for p in left[1]]
    assert len(points) < 30 and points[0] == line[0] and points[-1] == line[-1] and set(points) <= set(line)
    assert all(abs(y - np.interp(x, *zip(*points, strict=True))) <= 0.0101 for x, y in line)


def test_last_batch_stays(spark):
    from terrane.operators import lookup

    rows = spark.createDataFrame([(1, 2, "b", 5), (1, 1, "a", 9), (2, None, "x", 1), (2, 0, None, 2), (3, 4, "u", 1), (3, 4, "v", 0)], "k int, batch int, v string, w int")
    got = lookup.keep_last(rows, ["k"], "batch")
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == [(1, 2, "b", 5), (2, 0, None, 2), (3, 4, "v", 0)]


def test_length_of_lines_inside_polygons(spark):
    rng = random.Random(31)
    polygons = [(1, [[star(rng, 10, 20, 15, 14), star(rng, 10, 20, 5, 7)], [box(40, 0, 44, 9)]]), (2, [[box(-60, -60, -50, -50)]]), (3, [[box(0, 0, 60, 60)]])]
    lines = [(k, [(rng.uniform(-10, 50), rng.uniform(-5, 45)) for _ in range(2 + k % 4)]) for k in range(12)] + [(20, None), (21, [(1.0, 1.0)]), (22, [(2.0, 2.0), (2.0, 2.0)])]
    df = spark.createDataFrame(lines, "line int, path array<struct<x:double,y:double>>")
    got = {(r.line, r.u): r.km for r in outlines.length_inside(df, frame(spark, polygons, "u"), "line", "u").collect()}
    for k, path in lines[:12]:
        for u, shape in polygons:
            want = 0.0
            for (ax, ay), (bx, by) in zip(path, path[1:], strict=False):
                t = np.linspace(0, 1, 20001)
                x, y = ax + (bx - ax) * t, ay + (by - ay) * t
                step = KM * np.hypot(np.radians(np.diff(y)), np.radians(np.diff(x)) * np.cos(np.radians((y[1:] + y[:-1]) / 2)))
                want += step[covers((x[1:] + x[:-1]) / 2, (y[1:] + y[:-1]) / 2, shape)].sum()
            assert got.get((k, u), 0) == pytest.approx(want, rel=0.02, abs=1)  # the walk follows the bent line, the sum its chords
    assert {k for k, _ in got} <= set(range(12))
