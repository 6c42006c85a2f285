"""Distances between signatures and the spread of even draws."""

import math

import numpy as np
import pytest

from terrane.operators import pairs


def test_distance_matrix(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 5] = 2.0
    rows = [(u, f"v{k}", None if np.isnan(x[u, k]) else float(x[u, k])) for u in range(40) for k in range(6)] + [(3, "v9", float("nan"))]
    df = spark.createDataFrame(rows, "u int, name string, x double")
    sd = np.nanstd(x, axis=0)
    z = (x - np.nanmean(x, axis=0)) / np.where(sd > 0, sd, 1)
    for imputed in (True, False):
        got = {(r.a, r.b): r for r in pairs.distance_matrix(df, "u", "name", "x", imputed=imputed, tile=7).collect()}
        assert got.keys() == {(a, b) for a in range(40) for b in range(a + 1, 40)}
        for (a, b), r in got.items():
            both = np.ones(6, bool) if imputed else ~np.isnan(z[a]) & ~np.isnan(z[b])
            p, q = np.nan_to_num(z[a][both]), np.nan_to_num(z[b][both])
            norms = np.linalg.norm(p) * np.linalg.norm(q)
            assert r.n_common == both.sum() and r.euclidean == pytest.approx(math.dist(p, q))
            assert r.cosine == pytest.approx(1 - p @ q / norms if norms > 0 else 1.0)
    order = sorted((round(r.euclidean, 12), k) for k, r in got.items())
    top = pairs.ranked_pairs(pairs.distance_matrix(df, "u", "name", "x", imputed=False, tile=7), "euclidean", 4).collect()
    assert [(r.a, r.b) for r in sorted(top, key=lambda r: r.place) if r.kind == "similar"] == [k for _, k in order[:4]]
    assert {(r.a, r.b) for r in top if r.kind == "different"} == {k for _, k in order[-4:]}
    with pytest.raises(ValueError, match="matrix"):
        pairs.distance_matrix(df, "u", "name", "x", most=39)


def test_even_draws_agree_with_the_closed_form(spark):
    sizes = spark.createDataFrame([(1,), (2,), (9,), (200,), (9,), (0,)], "k int")
    rows = pairs.uniform_widths(sizes, draws=10_000, seed=3).toPandas()
    assert sorted(rows.k.unique()) == [1, 2, 9, 200] and len(rows) == 40_000
    mean = rows.groupby("k")[["width", "range"]].mean()

    def expected(k, q):
        """Mean of the quantile: the i-th of k even draws lies at 100 i / (k + 1) on average."""
        place = min(max(q * k + 0.5, 1), k)
        return 100 * place / (k + 1)

    for k in (1, 2, 9, 200):
        assert mean.range[k] == pytest.approx(100 * (k - 1) / (k + 1), abs=0.8)
        assert mean.width[k] == pytest.approx(expected(k, 0.9) - expected(k, 0.1), abs=0.8)
    # the range of k even draws is at most r with probability k r**(k - 1) - (k - 1) r**k
    share = (rows[rows.k == 9].range <= 80).mean()
    assert share == pytest.approx(9 * 0.8**8 - 8 * 0.8**9, abs=0.015)
    observed = spark.createDataFrame([("a", 9, 80.0), ("b", 200, 0.0), ("c", 0, 1.0)], "name string, k int, range double")
    got = {r.name: r for r in pairs.against_uniform(observed, "range", draws=10_000, seed=3).collect()}
    assert got["a"]["rank"] == pytest.approx(share) and got["b"]["rank"] == 0 and got["c"]["rank"] is None
    assert got["a"].null_p05 < got["a"].null_median < 90
