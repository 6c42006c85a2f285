"""Similarity lenses over units: distances, typed conditions, climate-style classes, terrain tolerances."""

from __future__ import annotations

from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import curves, scalars
from terrane.operators.lookup import stated
from terrane.operators.position import placed
from terrane.session import stored

#: Total below which a curve has no shape, coefficient of variation below which it is flat, correlation that
#: makes phases alike or opposite, temperature amplitude below which there is no thermal season; fit errors.
ARID, FLAT, ALIKE, THERMAL, FIT, MARGIN = 100.0, 0.20, 0.50, 5.0, 0.25, 0.02
#: Lens radii by stringency.
RADII = {"precip": {"strict": 0.25, "moderate": 0.60, "loose": 1.20}, "temp": {"strict": 0.25, "moderate": 0.75, "loose": 1.50}}
#: Tolerances of elevation, relief (m) and landform position.
TERRAIN = {"elevation": 300.0, "relief": 200.0, "position": 0.10}
#: Pairs of points up to which a diameter is computed pair by pair; largest set whose pairs are listed.
DIAMETER_PAIRS, PAIR_ROWS = 2_000_000, 20_000


def zscore_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: mean and population deviation of each feature over complete rows."""
    whole = df.na.drop(subset=features)
    return whole.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features))


def _asked(df: DataFrame, queries: DataFrame, unit: str) -> DataFrame:
    """The rows of the queries' units, with query_id; an error if there are more queries than may be broadcast."""
    one = df.groupBy(unit).agg(*(F.first(c).alias(c) for c in df.columns if c != unit))
    return one.join(stated(queries.select("query_id", F.col("query_id").alias(unit)).distinct(), "queries of a lens"), unit)


def euclidean(df: DataFrame, queries: DataFrame, features: list[str], unit: str) -> DataFrame:
    """query_id, unit, distance in z-scores, to each query row (query_id, features); incomplete rows are left out, a unit
    isn't compared with itself, and a feature without spread counts 0. Queries are a stated, small set."""
    z = df.na.drop(subset=features).join(F.broadcast(zscore_stats(df, features)))
    scaled = z.select(unit, *(F.coalesce(F.try_divide(F.col(f) - F.col(f"m_{f}"), F.col(f"s_{f}")), F.lit(0.0)).alias(f"z_{f}") for f in features))
    q = _asked(scaled, queries, unit).select("query_id", *(F.col(f"z_{f}").alias(f"q_{f}") for f in features))
    # a unit meets queries in this order, so that like ones leave runs of one distance, which files hold once; the optimiser drops
    # a sort below a join unless its rows are stored
    q = stored(q.sort(*(f"q_{f}" for f in features), "query_id"))
    both = scaled.join(F.broadcast(q), F.col(unit) != F.col("query_id"))  # no more rows than the checked queries
    d2 = sum((F.pow(F.col(f"z_{f}") - F.col(f"q_{f}"), F.lit(2)) for f in features), F.lit(0.0))
    return both.select("query_id", unit, F.sqrt(d2).alias("distance"))


def covariance(df: DataFrame, features: list[str]) -> np.ndarray:
    """Sample covariance over complete rows: one aggregate row."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    row = df.na.drop(subset=features).agg(*(F.covar_samp(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((len(features),) * 2)
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"c{i}_{j}"]
    return out


def mahalanobis(df: DataFrame, queries: DataFrame, features: list[str], unit: str) -> DataFrame:
    """As euclidean, by the quadratic form of the inverse covariance; of the generalised inverse where features are constant or
    depend on each other, so that directions without spread have no part."""
    spread = covariance(df, features)
    inverse = np.linalg.inv(spread) if np.linalg.matrix_rank(spread, hermitian=True) == len(features) else np.linalg.pinv(spread, hermitian=True)
    whole = df.na.drop(subset=features).select(unit, *features)
    q = _asked(whole, queries, unit).select("query_id", *(F.col(f).cast("double").alias(f"q_{f}") for f in features))
    both = whole.join(F.broadcast(q), F.col(unit) != F.col("query_id"))  # no more rows than the checked queries
    d = [F.col(f) - F.col(f"q_{f}") for f in features]
    form = sum((d[i] * d[j] * float(inverse[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return both.select("query_id", unit, F.sqrt(F.greatest(F.lit(0.0), form)).alias("distance"))


def mahalanobis_nearest(df: DataFrame, queries: DataFrame, features: list[str], unit: str, k: int) -> DataFrame:
    """query_id, unit, distance, rank: each query's ``k`` nearest by ``mahalanobis``, ties to the smaller unit, for any number of queries.

    Along the axes of the covariance the distance is Euclidean, so rows are dealt to cells of up to three axes and a query meets
    the cells around its own, as wide as a reach. A query that has ``k`` rows within the reach is done, the others try twice as
    far, up to the whole extent. Of rows that are alike only the k + 1 smallest units can be among the nearest.
    """
    spread = covariance(df, features)
    inverse = np.linalg.inv(spread) if np.linalg.matrix_rank(spread, hermitian=True) == len(features) else np.linalg.pinv(spread, hermitian=True)
    size, axes = np.linalg.eigh(inverse)
    # the axes along which rows differ most
    used = [a for a in np.argsort(-size) if size[a] > 1e-12 * size.max()][:3]
    along = [sum((F.col(f) * float(axes[i, a] * np.sqrt(size[a])) for i, f in enumerate(features)), F.lit(0.0)) for a in used]
    names = [f"_w{i}" for i in range(len(used))]
    whole = stored(df.na.drop(subset=features).select(unit, *(F.col(f).cast("double").alias(f) for f in features)).select("*", *(w.alias(n) for w, n in zip(along, names, strict=True))))
    alike = Window.partitionBy(*features).orderBy(unit)
    points = stored(whole.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1).drop("_n"))
    left = stored(whole.join(queries.select("query_id", F.col("query_id").alias(unit)).distinct(), unit).select("query_id", *(F.col(f).alias(f"q_{f}") for f in features), *names))
    n, *ends = points.agg(F.count("*"), *(F.max(w) - F.min(w) for w in names)).first()
    extent = 1.001 * (sum(e or 0.0 for e in ends) + 1e-9)
    reach, done = min(extent, (100.0 / max(n, 1)) ** (1 / max(1, len(used)))), None
    d = [F.col(f) - F.col(f"q_{f}") for f in features]
    form = sum((d[i] * d[j] * float(inverse[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy("distance", unit)
    cells = [f"_c{i}" for i in range(len(used))]
    while True:
        last, width = reach >= extent, reach * 1.001
        cell = lambda w: F.floor(F.col(w) / width)  # noqa: B023, E731
        p = points.select(unit, *features, *(cell(w).alias(c) for w, c in zip(names, cells, strict=True)))
        q = left
        for w, c in zip(names, cells, strict=True):
            q = q.withColumn(c, F.explode(F.sequence(cell(w) - 1, cell(w) + 1)))
        met = p.join(q.drop(*names).hint("shuffle_hash"), cells) if cells else p.join(F.broadcast(q))
        near = met.where(F.col(unit) != F.col("query_id")).select("query_id", unit, F.sqrt(F.greatest(F.lit(0.0), form)).alias("distance"))
        near = near if last else near.where(F.col("distance") <= reach)
        found = stored(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        full = found.where(F.col("rank") == k).select("query_id")
        part = found if last else found.join(full, "query_id", "left_semi")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        left = stored(left.join(full, "query_id", "left_anti"))
        if left.isEmpty():
            return done
        reach = min(2 * reach, extent)


def within(distances: DataFrame, radius: float, corpus: DataFrame | None, unit: str) -> DataFrame:
    """Threshold mode, restricted to the units of ``corpus`` if given."""
    hit = distances.where(F.col("distance") <= radius)
    return hit if corpus is None else hit.join(corpus.select(unit), unit, "left_semi")


def nearest(distances: DataFrame, k: int, unit: str) -> DataFrame:
    """The k nearest of each query with their rank; ties to the smaller unit."""
    w = Window.partitionBy("query_id").orderBy("distance", unit)
    return distances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def conjunction(df: DataFrame, query: DataFrame, conditions: list[tuple[str, Column]], unit: str) -> DataFrame:
    """Units with one boolean column for each condition and ``member`` for all of them, against one query row whose columns
    start with q_. A condition that is null isn't met; the query itself is no member but counts in the conditions."""
    both = df.join(F.broadcast(query))
    named = both.select(unit, F.col(f"q_{unit}"), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions))
    every = F.lit(True)
    for n, _ in conditions:
        every = every & F.col(n)
    return named.withColumn("member", every & (F.col(unit) != F.col(f"q_{unit}"))).drop(f"q_{unit}")


def attrition(members: DataFrame, names: list[str]) -> DataFrame:
    """condition, position, n_alone, n_left: how many units meet it, and how many meet it and all before."""
    alone = [F.count_if(F.col(n)).alias(f"a{i}") for i, n in enumerate(names)]
    left, so_far = [], F.lit(True)
    for i, n in enumerate(names):
        so_far = so_far & F.col(n)
        left.append(F.count_if(so_far).alias(f"l{i}"))
    row = members.agg(*alone, *left)
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("condition"), F.lit(i).alias("position"), F.col(f"a{i}").alias("n_alone"), F.col(f"l{i}").alias("n_left")) for i, n in enumerate(names)))))


def diameter_km(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """One row: the largest distance of two points; null for fewer than two points.

    Points are put together in cells, and pairs of cells that can't hold a pair as far apart as one already known are left out.
    The others are cut into smaller cells until few pairs of points are left, which are compared.
    """
    known = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    spots = stored(known.groupBy(F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo")).agg(F.count("*").alias("_n")))
    far = lambda a, b: scalars.haversine_km(F.col(f"{a}.la"), F.col(f"{a}.lo"), F.col(f"{b}.la"), F.col(f"{b}.lo"))
    step, kept = 16.0, None
    while True:
        at = [F.floor(F.col(c) / step).alias(f"_{c}") for c in ("la", "lo")]
        up = [F.floor(F.col(c) / (4 * step)).alias(f"_u{c}") for c in ("la", "lo")]
        ends = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("la", "lo")]
        boxes = spots.groupBy(F.struct(*at).alias("id"), F.struct(*up).alias("up")).agg(F.count("*").alias("n"), F.min(F.struct("la", "lo")).alias("one"), *ends)
        middle = F.struct(((F.col("min_la") + F.col("max_la")) / 2).alias("la"), ((F.col("min_lo") + F.col("max_lo")) / 2).alias("lo"))
        # no point of a box is farther from its middle than half its sides
        radius = F.radians((F.col("max_la") - F.col("min_la") + F.col("max_lo") - F.col("min_lo")) / 2) * scalars.EARTH_KM
        boxes = stored(boxes.select("id", "up", F.struct("id", "n", "one", middle.alias("middle"), radius.alias("radius")).alias("box")))
        a, b = (boxes.select(F.col("up").alias(f"_up_{c}"), F.col("box").alias(c)) for c in "ab")
        met = a.join(F.broadcast(b), F.lit(True)) if kept is None else kept.join(a, "_up_a").join(b, "_up_b")
        once = F.expr("a.id <= b.id")
        met = met.where(once if kept is None else once | (F.col("_up_a") != F.col("_up_b"))).select("a", "b", far("a.one", "b.one").alias("_least"), (far("a.middle", "b.middle") + F.col("a.radius") + F.col("b.radius")).alias("_most"))
        met = stored(met)
        best = met.agg(F.max("_least")).first()[0]
        if best is None:
            return points.sparkSession.range(1).select(F.lit(None).cast("double").alias("diameter_km"))
        kept = met.where(F.col("_most") >= best - 1e-6)
        left = kept.agg(F.sum(F.col("a.n") * F.col("b.n"))).first()[0]
        if left <= DIAMETER_PAIRS or step < 1e-6:
            break
        kept = kept.select(F.col("a.id").alias("_up_a"), F.col("b.id").alias("_up_b"))
        kept = kept.select(*(F.struct(F.col(f"{c}._la").alias("_ula"), F.col(f"{c}._lo").alias("_ulo")).alias(c) for c in ("_up_a", "_up_b")))
        step /= 4
    members = lambda c: spots.select(F.struct(*at).alias(f"_{c}"), F.struct("la", "lo").alias(c))
    pairs = kept.select(F.col("a.id").alias("_a"), F.col("b.id").alias("_b")).join(members("a"), "_a").join(members("b"), "_b")
    n = spots.agg(F.sum("_n").alias("_n"))
    longest = pairs.agg(F.max(far("a", "b")).alias("_d"))
    return longest.join(F.broadcast(n)).select(F.when(F.col("_n") > 1, F.col("_d")).alias("diameter_km"))


def _fit_errors(p: np.ndarray, period: int) -> np.ndarray:
    """Least mean error, over the mean, of a one-wave curve of ``period`` months among a grid of amplitudes and shifts."""
    amp = np.arange(81) * 0.05
    shift = np.linspace(0, period, 4 * period, endpoint=False)
    cr = np.where(amp > 1, -0.001 * amp**4 + 0.026 * amp**3 - 0.245 * amp**2 + 0.2432 * amp - 0.038, 0.0)
    wave = np.sin(2 * pi * (np.arange(12)[None, :] - shift[:, None]) / period)
    unit = np.maximum(0, 1 + cr[:, None, None] + amp[:, None, None] * wave[None]).reshape(-1, 12)
    mean = p.mean(1)
    out = np.full(len(p), np.inf)
    for start in range(0, len(unit), 256):
        part = unit[start : start + 256]
        out = np.minimum(out, np.abs(part[None] * mean[:, None, None] - p[:, None]).mean(2).min(1) / mean)
    return out


@F.pandas_udf(T.StructType().add("e12", T.DoubleType()).add("e6", T.DoubleType()))
def two_period_fit(curve: pd.Series) -> pd.DataFrame:
    """Fit errors of one and of two waves a year, by a grid that has no closed form; null for unusable curves."""
    ok = curve.map(lambda c: c is not None and len(c) == 12 and np.isfinite(np.array(c, float)).all() and np.sum(c) > 0)
    out = pd.DataFrame({"e12": np.nan, "e6": np.nan}, index=curve.index)
    for start in range(0, int(ok.sum()), 64):
        at = curve.index[ok][start : start + 64]
        p = np.stack(curve[at].to_numpy()).astype(float)
        out.loc[at, "e12"], out.loc[at, "e6"] = _fit_errors(p, 12), _fit_errors(p, 6)
    return out


def modality_class(curve: Column, total: Column, e12: Column, e6: Column) -> Column:
    """arid, aseasonal, undetermined, two seasons or one season."""
    unsure = (F.least(e12, e6) > FIT) & (F.abs(e12 - e6) < MARGIN)
    return F.when(total < ARID, "arid").when(curves.cv(curve) < FLAT, "aseasonal").when(unsure, "undetermined").when(e12 - e6 > 0, "two seasons").otherwise("one season")


def phase_class(rain: Column, warmth: Column, amplitude: Column) -> Column:
    """No thermal season; rain in the warm or the cool season; weak."""
    r = curves.pearson(rain, warmth)
    return F.when(amplitude < THERMAL, "no thermal cycle").when(r >= ALIKE, "warm-wet").when(r <= -ALIKE, "cool-wet").otherwise("weak")


def terrain_rank(df: DataFrame, query: DataFrame, unit: str, tolerances: dict[str, float] | None = None, elevation_weight: float = 1.0) -> DataFrame:
    """Units within every tolerance of the one query row, by distance in tolerances: unit, distance, rank."""
    tol = tolerances or TERRAIN
    both = df.join(F.broadcast(query.select(F.col(unit).alias("_q"), *(F.col(f).alias(f"_{f}") for f in tol)))).where(F.col(unit) != F.col("_q"))
    for f, d in tol.items():
        both = both.where(F.abs(F.col(f) - F.col(f"_{f}")) <= d)
    w = {f: elevation_weight if f == "elevation" else 1.0 for f in tol}
    far = F.sqrt(sum((w[f] * F.pow((F.col(f) - F.col(f"_{f}")) / d, F.lit(2)) for f, d in tol.items()), F.lit(0.0)))
    return placed(both.select(unit, far.alias("distance")), [F.col("distance"), F.col(unit)])


def vector_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    x, y = (F.transform(c, lambda v: v.cast("double")) for c in (a, b))
    return F.try_divide(curves.dot(x, y), F.sqrt(curves.dot(x, x) * curves.dot(y, y)))


def cell_key(*axes: Column) -> Column:
    """The cell of a row on several class axes, "a | b"; null if any axis is."""
    return F.concat(axes[0], *(x for a in axes[1:] for x in (F.lit(" | "), a)))


def class_lens(df: DataFrame, queries: DataFrame, unit: str, cell: str) -> DataFrame:
    """(query_id, unit): the units in the same cell as each query's unit, without itself."""
    own = queries.select("query_id", F.col("query_id").alias(unit)).join(df.select(unit, cell), unit).select("query_id", cell)
    return own.join(df.select(unit, cell), cell).where(F.col(unit) != F.col("query_id")).select("query_id", unit)


def relief(points: DataFrame, key: str, value: str, least: int = 3) -> DataFrame:
    """key, n, low, high, relief, mean, sd over the points with a value (land); keys with fewer than ``least`` have no row."""
    out = points.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return out.where(F.col("n") >= least).select(key, "n", "low", "high", (F.col("high") - F.col("low")).alias("relief"), "mean", "sd")


def distance_pairs(df: DataFrame, unit: str, features: list[str]) -> DataFrame:
    """(a, b, distance, similarity) with a < b for all pairs of a small table, such as one row for each class or place:
    Euclidean distance and 1 / (1 + distance)."""
    a, b = (df.select(F.col(unit).alias(c), *(F.col(f).alias(f"{c}_{f}") for f in features)) for c in "ab")
    d = F.sqrt(sum((F.pow(F.col(f"a_{f}") - F.col(f"b_{f}"), F.lit(2)) for f in features), F.lit(0.0)))
    return a.join(stated(b, "distance pairs", PAIR_ROWS), F.col("a") < F.col("b")).select("a", "b", d.alias("distance")).withColumn("similarity", 1 / (1 + F.col("distance")))
