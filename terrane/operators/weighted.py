"""Weighted statistics by group. Every order has the unit's id as its last key, so results don't depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Histogram bins.
BINS = 20


def wmean(value: str, weight: str) -> Column:
    """Weighted mean over rows with a value."""
    has = F.col(value).isNotNull()
    return F.try_divide(F.sum(F.when(has, F.col(weight) * F.col(value))), F.sum(F.when(has, F.col(weight))))


def coverage(value: str, weight: str) -> Column:
    """Weight of the rows with a value."""
    return F.sum(F.when(F.col(value).isNotNull(), F.col(weight)).otherwise(0.0))


def overlap_sum(value: str, share: str) -> Column:
    """Sum of an extensive quantity, each unit's by the share of it that lies inside."""
    return F.sum(F.col(value) * F.col(share))


def wsd(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted standard deviation about the weighted mean: keys, mean, sd, w_eff (Kish's effective number)."""
    rows = df.where(F.col(value).isNotNull())
    whole = Window.partitionBy(*keys)
    m = F.sum(F.col(weight) * F.col(value)).over(whole) / F.sum(weight).over(whole)
    dev = rows.withColumn("_m", m).withColumn("_d", F.col(weight) * F.pow(F.col(value) - F.col("_m"), 2))
    return dev.groupBy(*keys).agg(
        F.first("_m").alias("mean"),
        F.sqrt(F.try_divide(F.sum("_d"), F.sum(weight))).alias("sd"),
        F.try_divide(F.pow(F.sum(weight), F.lit(2)), F.sum(F.col(weight) * F.col(weight))).alias("w_eff"),
    )


def cumulated(df: DataFrame, keys: list[str], unit: str, value: str, weight: str) -> DataFrame:
    """Rows with a value, by value and unit: w (share of the group's weight), cum (share up to the row), and the next row's
    value and cum."""
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    order = Window.partitionBy(*keys).orderBy(value, unit)
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("w", F.col(weight) / F.sum(weight).over(whole))
    rows = rows.withColumn("cum", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("next_value", F.lead(value).over(order)).withColumn("next_cum", F.lead("cum").over(order)).withColumn("prev_cum", F.lag("cum").over(order))


def _interpolate(value: str, at: str, next_at: str, q: float) -> Column:
    """Aggregate: the value at ``q``, linear between neighbours, the first and last value beyond them."""
    inside = (F.col(at) <= q) & (F.col(next_at) > q)
    step = F.try_divide(q - F.col(at), F.col(next_at) - F.col(at))
    between = F.max(F.when(inside, F.col(value) + (F.col("next_value") - F.col(value)) * step))
    low = F.when(F.min(at) >= q, F.min(value))
    return F.coalesce(low, between, F.max(value))


def quantile_parts(value: str, qs: dict[str, float]) -> list[tuple[str, Column, str]]:
    """Aggregates of parts of a group, from ``pooled`` rows, and how they add up; ``from_parts`` makes the quantiles of them."""
    some = lambda c: F.when(F.col("w").isNotNull(), F.col(c))
    parts = [("_at", F.min("cum"), "min"), ("least", F.min(some(value)), "min"), ("most", F.max(some(value)), "max")]
    for name, q in qs.items():
        step = f"{value} + (next_value - {value}) * try_divide({q} - cum, next_cum - cum)"
        parts.append((f"_{name}", F.expr(f"max(CASE WHEN cum <= {q} AND next_cum > {q} THEN {step} END)"), "max"))
    return parts


def from_parts(qs: dict[str, float]) -> list[Column]:
    return [F.expr(f"coalesce(CASE WHEN _at >= {q} THEN least END, _{name}, most)").alias(name) for name, q in qs.items()]


def pooled(df: DataFrame, keys: list[str], unit: str, value: str, weight: str) -> DataFrame:
    """All rows, with the columns of ``cumulated`` where there is a value and weight (null elsewhere) and ``tie``, the weight of
    the rows of equal value. One shuffle by the keys and one sort serve these windows and whatever is grouped by the keys
    afterwards."""
    some = F.col(value).isNotNull() & (F.col(weight) > 0)
    rows = df.withColumn("_v", F.when(some, F.col(value)))
    whole, equal = Window.partitionBy(*keys), Window.partitionBy(*keys, "_v")
    order = whole.orderBy(F.asc_nulls_last("_v"), unit)
    rows = rows.withColumn("w", F.when(some, F.col(weight)) / F.sum(F.when(some, F.col(weight))).over(whole))
    rows = rows.withColumn("cum", F.when(some, F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("next_value", F.lead("_v").over(order)).withColumn("next_cum", F.lead("cum").over(order))
    return rows.withColumn("tie", F.sum("w").over(equal)).drop("_v")


def quantiles(cum: DataFrame, keys: list[str], value: str, qs: dict[str, float], extra: list[Column] | None = None) -> DataFrame:
    """Weighted quantiles by cumulative weight, from ``cumulated`` rows: one column for each name in ``qs``."""
    return cum.groupBy(*keys).agg(*(_interpolate(value, "cum", "next_cum", q).alias(n) for n, q in qs.items()), *(extra or []))


def midpoint_quantiles(cum: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Weighted quantiles by the middle of each row's weight."""
    mid = cum.withColumn("_mid", F.col("cum") - F.col("w") / 2)
    order = Window.partitionBy(*keys).orderBy("cum", "_mid")
    mid = mid.withColumn("_next", F.lead("_mid").over(order))
    return mid.groupBy(*keys).agg(*(_interpolate(value, "_mid", "_next", q).alias(n) for n, q in qs.items()))


def histogram(df: DataFrame, keys: list[str], value: str, weight: str, bins: int = BINS) -> DataFrame:
    """Weights in equal bins between least and largest value; a single value gets bins half a unit to each side.
    keys, lo, hi, bin (from 0), weight (share of the group's); empty bins have weight 0."""
    rows = df.where(F.col(value).isNotNull())
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("_lo", F.min(value).over(whole)).withColumn("_hi", F.max(value).over(whole)).withColumn("_w", F.col(weight) / F.sum(weight).over(whole))
    flat = F.col("_lo") == F.col("_hi")
    rows = rows.withColumn("lo", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))).withColumn("hi", F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    seen = rows.groupBy(*keys, "lo", "hi", at.cast("int").alias("bin")).agg(F.sum("_w").alias("weight"))
    frame = seen.select(*keys, "lo", "hi").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(seen, [*keys, "lo", "hi", "bin"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def floor_percentile(sorted_values: Column, p: float) -> Column:
    """The element at floor(p (n - 1)) of a sorted array; no interpolation."""
    return F.element_at(sorted_values, (F.floor(F.lit(p) * (F.size(sorted_values) - 1)) + 1).cast("int"))


def skewness(c: str) -> Column:
    """Bias-corrected sample skewness; null for fewer than 3 values or no spread."""
    n = F.count(c)
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: str) -> Column:
    """Bias-corrected sample excess kurtosis; null for fewer than 4 values or no spread."""
    n = F.count(c)
    return F.when((n > 3) & (F.stddev_pop(c) > 0), ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def zero_fraction(c: str) -> Column:
    return F.avg(F.when(F.col(c).isNotNull(), (F.col(c) == 0).cast("double")))


def shares(df: DataFrame, keys: list[str], label: str, weight: str, renormalise: bool = True, least: float = 0.0) -> DataFrame:
    """keys, label, share: each class's part of the group's weight, without parts below ``least``."""
    parts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.sum(weight).alias("share"))
    if renormalise:
        parts = parts.withColumn("share", F.try_divide(F.col("share"), F.sum("share").over(Window.partitionBy(*keys))))
    return parts.where(F.col("share") >= least)


def mixture(parts: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, modal_class (ties to the least label), modal_share, n_classes, concentration (sum of squared shares), entropy in
    bits and over its largest value."""
    bits = -F.sum(F.col("share") * F.log2("share"))
    return parts.groupBy(*keys).agg(
        F.min_by(label, F.struct(-F.col("share"), F.col(label))).alias("modal_class"),
        F.max("share").alias("modal_share"),
        F.count("*").alias("n_classes"),
        F.sum(F.col("share") * F.col("share")).alias("concentration"),
        bits.alias("entropy"),
        F.coalesce(F.try_divide(bits, F.log2(F.count("*"))), F.lit(0.0)).alias("evenness"),
    )


def stratified_rates(population: DataFrame, sample: DataFrame, stratum: str, value: str, cutoffs: list[float]) -> DataFrame:
    """cutoff, rate: the share of the population whose value reaches each cutoff, from a sample whose rows weigh their stratum's
    size over the stratum's sampled rows."""
    size = population.groupBy(stratum).agg(F.count("*").alias("_size"))
    some = sample.groupBy(stratum).agg(F.count("*").alias("_n"), *(F.count_if(F.col(value) >= c).alias(f"_c{i}") for i, c in enumerate(cutoffs)))
    w = F.col("_size") / F.col("_n")
    one = some.join(size, stratum).agg(F.sum("_size").alias("_all"), *(F.sum(w * F.col(f"_c{i}")).alias(f"_s{i}") for i in range(len(cutoffs))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(float(c)).alias("cutoff"), (F.col(f"_s{i}") / F.col("_all")).alias("rate")) for i, c in enumerate(cutoffs)))))
