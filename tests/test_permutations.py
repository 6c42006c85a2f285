"""Permutation tests against plain versions that use the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import spatialstats

ROUNDS = 39


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), "abc"[i % 3] if i % 10 else None, float(rng.normal() + i % 3), float(rng.normal(scale=1 + i % 4))) for i in range(60)]
    return rows, spark.createDataFrame(rows, "unit long, g int, block string, x double, y double")


def orders(spark, units, rounds=ROUNDS, seed=0):
    """Units of each round by the hash that the operators order them by."""
    df = spark.createDataFrame([(u,) for u in units], "unit long").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    rows = df.select("unit", "round", F.xxhash64("unit", "round", F.lit(seed)).alias("h")).collect()
    out = {r: [] for r in range(1, rounds + 1)}
    for r in sorted(rows, key=lambda r: (r.h, r.unit)):
        out[r.round].append(r.unit)
    return out


def shuffled(rows, order, key):
    """Labels of the rows in a round: within a block, the label of the k-th by hash goes to the k-th by id."""
    label, block = {r[0]: r[1] for r in rows}, {r[0]: key(r) for r in rows}
    out = {}
    for b in set(block.values()):
        members = sorted(u for u in block if block[u] == b)
        out |= dict(zip(members, (label[u] for u in order if block[u] == b), strict=True))
    return np.array([out[r[0]] for r in rows])


def f_of(v, g, within=None):
    n, labels = len(v), sorted(set(g))
    total = ((v - v.mean(0)) ** 2).sum()
    inner = sum(((v[g == k] - v[g == k].mean(0)) ** 2).sum() for k in labels)
    return (total - inner) / (len(labels) - 1) / (inner / (n - len(labels)))


def spread(v, g):
    d = np.zeros(len(v))
    for k in set(g):
        d[g == k] = np.sqrt(((v[g == k] - v[g == k].mean(0)) ** 2).sum(1))
    return f_of(d[:, None], g)


@pytest.mark.parametrize(("operator", "statistic"), [(spatialstats.permanova_p, f_of), (spatialstats.dispersion_p, spread)])
@pytest.mark.parametrize("blocks", [None, "block", "unit"])
def test_restricted_permutations(spark, points, operator, statistic, blocks):
    rows, df = points
    v, g = np.array([r[3:] for r in rows]), np.array([r[1] for r in rows])
    one, order = statistic(v, g), orders(spark, [r[0] for r in rows])
    key = {None: lambda r: 0, "block": lambda r: r[2], "unit": lambda r: r[0]}[blocks]
    large = sum(statistic(v, shuffled(rows, order[k], key)) >= one - 1e-12 for k in order)
    r = operator(df.withColumn("unit_block", F.col("unit")), "g", ["x", "y"], "unit", ROUNDS, blocks="unit_block" if blocks == "unit" else blocks).first()
    assert r.f == pytest.approx(one) and r.p == pytest.approx((large + 1) / (ROUNDS + 1))
    assert blocks != "unit" or r.p == 1  # blocks of one row leave all labels where they are


@pytest.mark.parametrize("bivariate", [False, True])
def test_conditional_permutations(spark, points, bivariate):
    rows, df = points
    units = [r[0] for r in rows]
    links = sorted({(a, b) for a in units for b in (a - 1, a + 1, a // 2, 3) if b in units and a != b} | {(7, b) for b in units if b != 7})
    weights = spatialstats.row_standardised(spark.createDataFrame(links, "i long, j long"))
    z, other = spatialstats.mean_imputed(df, "unit", "x"), spatialstats.mean_imputed(df, "unit", "y")
    x, y = ({r.unit: r.z for r in f.collect()} for f in (z, other if bivariate else z))
    order, scale = orders(spark, units), np.sqrt(np.mean(np.square(list(x.values()))) * np.mean(np.square(list(y.values()))))
    got = {r.unit: r for r in spatialstats.lisa(z, weights, ROUNDS, level=0.3, other=other if bivariate else None).collect()}
    quadrants = {r.unit: r.quadrant for r in spatialstats.local_moran(z, weights, other if bivariate else None).collect()}
    assert len(got) == len(units)
    for u in units:
        near = [b for a, b in links if a == u]
        lag = np.mean([y[b] for b in near])
        draws = [np.mean([y[b] for b in [v for v in order[k] if v != u][: len(near)]]) for k in order]
        if u == 7:  # all others are its neighbours, whatever the order
            draws = [lag] * ROUNDS
            assert got[u].p == pytest.approx(1, abs=0.999)
            continue
        p = (min(sum(d >= lag for d in draws), sum(d <= lag for d in draws)) + 1) / (ROUNDS + 1)
        assert got[u].p == pytest.approx(p) and got[u].local_i == pytest.approx(x[u] * lag / scale)
        assert got[u].cluster == (quadrants[u] if p < 0.3 else "NS")


@pytest.mark.parametrize("stratified", [False, True])
def test_random_draws(spark, stratified):
    from terrane.operators import scan

    rng = np.random.default_rng(2)
    rows = [(i, "xyz"[i % 3] if i % 11 else None, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    df = spark.createDataFrame(rows, "unit long, family string, z_x double, z_y double")
    within = spark.createDataFrame([("x", 4), ("z", 7)], "family string, k int") if stratified else None
    got = {r["round"]: r for r in scan.random_draws(df, "unit", ["x", "y"], 12, ROUNDS, within=within, family="family" if stratified else None).collect()}
    family, at = {r[0]: r[1] for r in rows}, {r[0]: np.array(r[2:]) for r in rows}
    for k, order in orders(spark, list(family)).items():
        chosen = [u for f, m in (("x", 4), ("z", 7)) for u in [v for v in order if family[v] == f][:m]] if stratified else order[:12]
        v = np.array([at[u] for u in chosen])
        assert got[k].cohesion == pytest.approx(np.sqrt(((v - v.mean(0)) ** 2).sum(1)).mean()) and got[k].displacement == pytest.approx(np.sqrt((v.mean(0) ** 2).sum()))


def test_isolates_against_all_pairs(spark):
    import math

    from terrane.operators import scan

    rng = np.random.default_rng(9)
    rows = [(i, "abcd"[int(rng.integers(4))] if i % 7 else None, float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180)), *(float(x) for x in rng.uniform(0, 100, 3)), bool(i % 3 == 0)) for i in range(150)]
    df = spark.createDataFrame(rows, "u long, f string, lat double, lon double, p double, q double, r double, h boolean")
    got = {x.u: x for x in scan.isolates(df, "u", "f", "lat", "lon", F.col("h"), ["p", "q", "r"]).collect()}
    held = [r for r in rows if r[-1]]

    def km(a, b):
        x = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(x))

    assert got.keys() == {r[0] for r in held}
    for a in held:
        others = [b for b in held if b[0] != a[0]]
        assert got[a[0]].km == pytest.approx(min(km(a, b) for b in others if a[1] is None or b[1] is None or a[1] != b[1]))
        assert got[a[0]].environment == pytest.approx(min(math.dist(a[4:7], b[4:7]) for b in others))
    by_km = sorted((-x.km for x in got.values()))
    assert all(x.rank_km == by_km.index(-x.km) + 1 for x in got.values())


def test_lenses_refuse_unbounded_queries_and_take_constant_features(spark, monkeypatch):
    from terrane.operators import lenses, lookup

    df = spark.createDataFrame([(i, float(i), 2.0, float(i * i)) for i in range(9)], "unit long, a double, b double, c double")
    asked = spark.createDataFrame([(1,), (4,)], "query_id long")
    plain = {(r.query_id, r.unit): r.distance for r in lenses.mahalanobis(df, asked, ["a", "c"], "unit").collect()}
    assert {(r.query_id, r.unit): r.distance for r in lenses.mahalanobis(df, asked, ["a", "b", "c"], "unit").collect()} == {k: pytest.approx(v) for k, v in plain.items()}
    assert lenses.euclidean(df, asked, ["a", "b"], "unit").where("distance IS NOT NULL").count() == 16
    monkeypatch.setattr(lookup.stated, "__defaults__", (1,))
    for lens in (lenses.euclidean, lenses.mahalanobis):
        with pytest.raises(ValueError, match="blocks"):
            lens(df, asked, ["a", "c"], "unit")
