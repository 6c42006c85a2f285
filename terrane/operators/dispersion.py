"""How a group's weight is spread over the score scale: core share, ties, dispersion tag, two regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.weighted import quantiles

#: Fixed values. Half width of the core window in points, share that makes a group concentrated, tie weight and residual
#: that make it split, fewest units for a tag; gap (as part of the spread) and side weight that make two regimes.
DELTA, CONCENTRATED, TIE, RESIDUAL, FEWEST = 15, 0.65, 0.50, 0.10, 5
GAP, SIDE = 0.50, 0.20


def folded(rows: DataFrame, keys: list[str], score: str, parts: list[tuple[str, Column, str]]) -> DataFrame:
    """One row for each group of ``weighted.pooled`` rows: keys, the ``parts`` (name, aggregate, and how parts of a group add up: sum,
    min or max) and _best, the (core_share, window_lo) of the window of width 2 * DELTA, at whole lower ends, that holds most
    weight.

    Rows are first added up by whole and half places of the score scale, at most 201 for a group, and windows are sums over
    those. Windows are closed; of equal windows the lowest counts. The sums are rounded to 12 places before they are compared,
    so that equal windows are equal whatever the order of summation.
    """
    at = F.when(F.col("w").isNotNull(), (2 * F.floor(score) + (F.col(score) > F.floor(score)).cast("int")).cast("int"))
    binned = rows.groupBy(*keys, at.alias("_bin")).agg(*(c.alias(n) for n, c, _ in parts), F.sum("w").alias("_bw"))
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    one = binned.groupBy(*keys).agg(*(merge[how](n).alias(n) for n, _, how in parts), F.expr("collect_list(CASE WHEN _bin IS NOT NULL THEN struct(_bin, _bw) END)").alias("_hist"))
    wide, lows = 2 * DELTA, 100 - 2 * DELTA
    held = f"aggregate(filter(_hist, h -> h._bin BETWEEN 2 * lo AND 2 * lo + {2 * wide}), 0D, (s, h) -> s + h._bw)"
    return one.withColumn("_best", F.expr(f"array_min(transform(sequence(0, {lows}), lo -> struct(-round({held}, 12) AS k, lo AS lo)))")).drop("_hist")


def tagged(rows: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """Turns the columns _best (from ``folded``), tie and n_units of one row per group into core_share, window_lo, window_hi and
    coherence: split, concentrated or spread; none for few units."""
    share = -F.col("_best.k")
    tag = F.when((F.col("tie") >= TIE) & (1 - share >= RESIDUAL), "split").when(share >= CONCENTRATED, "concentrated").otherwise("spread")
    some = F.col("n_units") > 0
    lo = F.when(some, F.col("_best.lo"))
    return rows.select("*", F.when(some, share).alias("core_share"), lo.alias("window_lo"), (lo + 2 * DELTA).alias("window_hi"), F.when(F.col("n_units") >= fewest, tag).alias("coherence")).drop("_best")


def dispersion(rows: DataFrame, keys: list[str], score: str, fewest: int = FEWEST) -> DataFrame:
    """keys, n_units, core_share, window_lo, window_hi, tie, coherence, of rows from ``weighted.pooled``."""
    one = folded(rows, keys, score, [("n_units", F.count("w"), "sum"), ("tie", F.max("tie"), "max")])
    return tagged(one, fewest).where("n_units > 0").select(*keys, "n_units", "core_share", "window_lo", "window_hi", "tie", "coherence")


def modality(cum: DataFrame, keys: list[str], score: str, gap: float = GAP, side: float = SIDE) -> DataFrame:
    """keys, modality, gap, low_weight, low_center, high_center.

    Of the gaps between neighbouring scores that exceed ``gap`` of the 10-90 spread and leave at least ``side`` of the weight on
    either hand, the widest makes two regimes; of equal gaps the lowest counts. Without one, or without a spread, there is one
    regime and the rest is null. Centres are weighted means of the sides.
    """
    spread = quantiles(cum, keys, score, {"_p10": 0.1, "_p90": 0.9}).select(*keys, (F.col("_p90") - F.col("_p10")).alias("_spread"))
    running = Window.partitionBy(*keys).orderBy(score, "cum").rowsBetween(Window.unboundedPreceding, 0)
    steps = cum.withColumn("_below", F.sum(F.col("w") * F.col(score)).over(running)).join(spread, keys)
    width = F.col("next_value") - F.col(score)
    # shares are compared to 12 places, so that sums don't depend on their order
    fits = (F.col("_spread") > 0) & (width > gap * F.col("_spread")) & (F.round("cum", 12) >= side) & (F.round(1 - F.col("cum"), 12) >= side)
    cut = F.min_by(F.struct(width.alias("gap"), F.col("cum").alias("low"), F.col("_below").alias("below")), F.when(fits, F.struct(-width, F.col(score))))
    out = steps.groupBy(*keys).agg(cut.alias("c"), F.sum(F.col("w") * F.col(score)).alias("_all"))
    two = F.col("c").isNotNull()
    return out.select(
        *keys, F.when(two, "two_regime").otherwise("unimodal").alias("modality"), F.col("c.gap").alias("gap"), F.col("c.low").alias("low_weight"),
        F.try_divide(F.col("c.below"), F.col("c.low")).alias("low_center"), F.try_divide(F.col("_all") - F.col("c.below"), 1 - F.col("c.low")).alias("high_center"),
    )
