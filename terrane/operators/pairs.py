"""Distances between signatures, and the spread that chance alone would give a set of percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most units whose matrix is listed, units of a tile, and most variables of a signature.
MATRIX_UNITS, TILE, VARIABLES = 5_000, 256, 2_000


def signature_zscores(values: DataFrame, unit: str, variable: str, value: str) -> DataFrame:
    """(unit, variable, z) over the known values of each variable, by population deviation; a variable without spread is divided by
    1. Rows that repeat a unit's variable count as their mean; null and NaN are no values."""
    known = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    one = known.groupBy(unit, variable).agg(F.avg(F.col(value).cast("double")).alias("_x"))
    stats = one.groupBy(variable).agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    return one.join(stats, variable).select(unit, variable, ((F.col("_x") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).alias("z"))


def _vectors(z: DataFrame, unit: str, variable: str, imputed: bool) -> DataFrame:
    """(unit, v): each unit's z in the order of the variables, a small catalog; an absent one is null, or the mean, 0."""
    names = [r[0] for r in z.select(variable).distinct().orderBy(variable).limit(VARIABLES + 1).collect()]
    if len(names) > VARIABLES:
        raise ValueError(f"more than {VARIABLES} variables")
    have = z.groupBy(unit).agg(F.map_from_entries(F.collect_list(F.struct(variable, "z"))).alias("_z"))
    at = lambda n: F.coalesce(F.element_at("_z", n), F.lit(0.0)) if imputed else F.element_at("_z", n)
    return have.select(unit, F.transform(F.array(*map(F.lit, names)), at).alias("v"))


def _measures(x: Column, y: Column) -> Column:
    both = F.filter(F.arrays_zip(x.alias("a"), y.alias("b")), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    total = lambda of: F.aggregate(both, F.lit(0.0), lambda s, p: s + of(p["a"], p["b"]))
    norms = F.sqrt(total(lambda a, b: a * a)) * F.sqrt(total(lambda a, b: b * b))
    return F.struct(
        F.size(both).cast("long").alias("n_common"), F.sqrt(total(lambda a, b: (a - b) * (a - b))).alias("euclidean"),
        F.when(norms > 0, 1 - total(lambda a, b: a * b) / norms).otherwise(1.0).alias("cosine"),
    )


def distance_matrix(values: DataFrame, unit: str, variable: str, value: str, imputed: bool = True, most: int = MATRIX_UNITS, tile: int = TILE) -> DataFrame:
    """(a, b, n_common, euclidean, cosine) with a < b for all pairs of a stated set of units, by z-scores. With ``imputed`` an
    absent value counts as the variable's mean; without, a pair is compared by the variables that both have.

    Units are dealt to tiles and a pair of tiles is one key of an equi-join, so the pairs are spread over all tasks. More than
    ``most`` units are an error, as the result is the square of their number.
    """
    v = _vectors(signature_zscores(values, unit, variable, value), unit, variable, imputed)
    n = v.select(unit).limit(most + 1).count()
    if n > most:
        raise ValueError(f"a matrix of more than {most} units; take fewer")
    tiles = max(1, -(-n // tile))
    at = v.select(F.col(unit).alias("_u"), "v", F.pmod(F.xxhash64(unit), F.lit(tiles)).cast("int").alias("_t"))
    a = at.select(F.col("_u").alias("_a"), F.col("v").alias("_x"), F.col("_t").alias("_i"), F.explode(F.sequence(F.col("_t"), F.lit(tiles - 1))).alias("_j"))
    b = at.select(F.col("_u").alias("_b"), F.col("v").alias("_y"), F.col("_t").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_t"))).alias("_i"))
    met = a.join(b, ["_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("_a") < F.col("_b")))
    return met.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), _measures(F.col("_x"), F.col("_y")).alias("_m")).select("a", "b", "_m.*")


def ranked_pairs(matrix: DataFrame, measure: str, n: int = 5) -> DataFrame:
    """kind (similar, different), place, a, b, distance: the n nearest and the n farthest pairs, ties by a and b. Each task keeps
    n pairs of either kind."""
    out = None
    for kind, order in (("similar", F.asc("distance")), ("different", F.desc("distance"))):
        some = matrix.select("a", "b", F.round(measure, 12).alias("distance")).where("distance IS NOT NULL").orderBy(order, "a", "b").limit(n)
        placed = some.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(order, "a", "b")).alias("place"), "a", "b", "distance")
        out = placed if out is None else out.unionByName(placed)
    return out


def uniform_widths(sizes: DataFrame, draws: int = 300, seed: int = 0) -> DataFrame:
    """(k, draw, width, range): for each size k, ``draws`` seeded sets of k percentiles drawn evenly from 0 to 100: the width of
    the middle 80 % (quantiles between the middles of equal weights, ends beyond them) and the range. A set is one row."""
    u = lambda i: F.shiftrightunsigned(F.xxhash64("k", "draw", i, F.lit(seed)), 11).cast("double") * (100 * 2.0**-53)
    rows = sizes.where("k > 0").select(F.col("k").cast("long").alias("k")).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    # a number of its own, as small rows that make long sets would be put together in one task
    parts = max(4, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "k", "draw").withColumn("s", F.sort_array(F.transform(F.sequence(F.lit(1).cast("long"), F.col("k")), u)))

    def quantile(q: float) -> Column:
        place = F.lit(q) * F.col("k") + 0.5  # middles stand at (i - 0.5) / k
        below = F.least(F.greatest(F.floor(place), F.lit(1)), F.col("k")).cast("int")
        above = F.least(F.greatest(F.floor(place) + 1, F.lit(1)), F.col("k")).cast("int")
        return F.element_at("s", below) + (F.element_at("s", above) - F.element_at("s", below)) * (place - F.floor(place))

    return rows.select("k", "draw", (quantile(0.9) - quantile(0.1)).alias("width"), (F.element_at("s", -1) - F.element_at("s", 1)).alias("range"))


def against_uniform(observed: DataFrame, measure: str, draws: int = 300, seed: int = 0) -> DataFrame:
    """``observed`` (with k and ``measure``, width or range) with rank (share of the draws at most as large), null_median and
    null_p05 of as many even draws. Sizes are few; the draws of one are put together in one row."""
    w = uniform_widths(observed.select("k"), draws, seed).groupBy("k").agg(F.collect_list(measure).alias("_w"), F.percentile(measure, 0.5).alias("null_median"), F.percentile(measure, 0.05).alias("null_p05"))
    joined = observed.join(w, "k", "left")
    return joined.select(*observed.columns, (F.size(F.filter("_w", lambda x: x <= F.col(measure))) / F.size("_w")).alias("rank"), "null_median", "null_p05")
