"""Series stored as arrays by position, grids and event catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First and last year of the annual grids and of the event catalogue.
GRID_YEARS, EVENT_YEARS = (0, 1998), (-491, 1890)
#: Bins of the land-use steps as first and last position in the array, and periods of years.
STEP_BINS = {1: (1, 7), 2: (8, 10), 3: (11, 11), 4: (12, 21), 5: (22, 28), 6: (29, 48), 7: (49, 128)}
PERIODS = ((700, 950), (950, 1250), (1250, 1450), (1450, 1850), (1850, 1998))


def clamped(low: Column, high: Column, years: tuple[int, int]) -> tuple[Column, Column]:
    """The part of a span that a source covers; low above high if none."""
    return F.greatest(low, F.lit(years[0])), F.least(high, F.lit(years[1]))


def year_slice(values: Column, low: Column | int, high: Column | int, first_year: int = 0) -> Column:
    """Values of the years low..high of an array whose first place is ``first_year``."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    start = F.greatest(a - first_year + 1, F.lit(1))
    return F.slice(values, start, F.greatest(F.lit(0), b - first_year + 1 - start + 1))


def array_mean(a: Column) -> Column:
    some = F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.try_divide(F.aggregate(some, F.lit(0.0), lambda s, x: s + x), F.size(some))


def period_mean(values: Column, low: int, high: int, first_year: int = 0) -> Column:
    return array_mean(year_slice(values, low, high, first_year))


def rebaselined(values: Column, low: int, high: int, base: tuple[int, int] = (850, 1850), first_year: int = 0) -> Column:
    """Mean of the span less the mean of the same cell's base period."""
    return period_mean(values, low, high, first_year) - period_mean(values, *base, first_year)


def first_bin(values: Column, bins: dict[int, tuple[int, int]] | None = None) -> Column:
    """Number of the first bin with any value above 0; null if none."""
    return F.coalesce(*(F.when(F.exists(F.slice(values, a, b - a + 1), lambda x: x > 0), k) for k, (a, b) in sorted((bins or STEP_BINS).items())))


def bin_count(values: Column, bins: dict[int, tuple[int, int]] | None = None) -> Column:
    """How many bins have any value above 0."""
    out = F.lit(0)
    for a, b in (bins or STEP_BINS).values():
        out = out + F.coalesce(F.exists(F.slice(values, a, b - a + 1), lambda x: x > 0), F.lit(False)).cast("int")
    return out


def bin_share(values: Column, area: Column, bin_: tuple[int, int]) -> Column:
    """Mean of a bin as a share of the cell's area, at most 1."""
    return F.least(F.lit(1.0), F.try_divide(array_mean(F.slice(values, bin_[0], bin_[1] - bin_[0] + 1)), area))


def exploded(cells: DataFrame, keys: list[str], values: str, first: int = 0) -> DataFrame:
    """keys, step (from ``first``), value."""
    return cells.select(*keys, F.posexplode(values).alias("_p", "value")).select(*keys, (F.col("_p") + first).alias("step"), "value")


def crosswalk_steps(cells: DataFrame, crosswalk: DataFrame, unit: str, cell: str, values: str, share: str, area: DataFrame, unit_area: str) -> DataFrame:
    """Pre-aggregated steps: unit, step, fraction of the unit's area, at most 1. Cells meet units first and are exploded then,
    so the join moves arrays once and not each step."""
    joined = crosswalk.join(cells, cell).select(unit, share, values)
    sums = joined.select(unit, share, F.posexplode(values).alias("step", "value")).groupBy(unit, "step").agg(F.sum(F.col("value") * F.col(share)).alias("total"))
    return sums.join(area, unit).select(unit, "step", F.least(F.lit(1.0), F.try_divide("total", unit_area)).alias("fraction"))


def decadal(series: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    return series.groupBy(*keys, (F.floor(F.col(year) / 10) * 10).cast("int").alias("decade")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def epoch_steps(low: Column, high: Column, years: list[int]) -> Column:
    """Steps within the span, or the one nearest to its middle (floor of the mean; ties to the earlier)."""
    all_ = F.array(*map(F.lit, years))
    inside = F.filter(all_, lambda y: y.between(low, high))
    mid = F.floor((low + high) / 2)
    nearest = F.array_min(F.transform(all_, lambda y: F.struct(F.abs(y - mid).alias("d"), y.alias("y"))))["y"]
    return F.when(F.size(inside) > 0, inside).otherwise(F.array(nearest))


def events_in(queries: DataFrame, events: DataFrame, low: str, high: str, year: str, size: str, least: float = 5.0, years: tuple[int, int] = EVENT_YEARS) -> DataFrame:
    """Each query with the events of at least ``least`` in the part of its span that the catalogue covers.

    Queries are dealt to the years of their spans, so the join is by equality and a long span is many rows, not a nested loop.
    """
    a, b = clamped(F.col(low), F.col(high), years)
    dealt = queries.where(a <= b).withColumn("_year", F.explode(F.sequence(a, b)))
    return dealt.join(events.where(F.col(size) >= least).withColumn("_year", F.col(year)), "_year").drop("_year")


def event_summary(queries: DataFrame, events: DataFrame, query: str, low: str, high: str, year: str, size: str, least: float = 5.0, major: float = 10.0, years: tuple[int, int] = EVENT_YEARS) -> DataFrame:
    """query, n_events, total of the events of at least ``least`` in the span (0 if none), and years from the last major one of
    them to the span's end. Sizes may be decimals, whose total doesn't depend on the order of rows."""
    hit = events_in(queries, events, low, high, year, size, least, years)
    out = hit.groupBy(query).agg(F.count("*").alias("n_events"), F.sum(size).cast("double").alias("total"), F.min(F.when(F.col(size) >= major, F.col(high) - F.col(year))).alias("years_since_major"))
    return queries.select(query).join(out, query, "left").select(query, F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("total", F.lit(0.0)).alias("total"), "years_since_major")


def grid_cell(lat: Column, lon: Column, step: float) -> tuple[Column, Column]:
    """Row from the north and column from the west of the raster cell that holds the point."""
    return F.floor((90 - lat) / step).cast("int"), F.floor(F.pmod(lon + 180, F.lit(360.0)) / step).cast("int")


def nearest_grid_point(lat: Column, lon: Column, step: float) -> tuple[Column, Column]:
    """Latitude and east longitude (0 up to 360) of the nearest node of a regular grid: arithmetic, not a search."""
    return F.round(lat / step) * step, F.pmod(F.round(F.pmod(lon, F.lit(360.0)) / step) * step, F.lit(360.0))


def month_value(months: Column, month: Column) -> Column:
    """The value of a month, 1 to 12, of an array of twelve; null for other numbers."""
    return F.get(months, F.when(month.between(1, 12), (month - 1).cast("int")).otherwise(F.lit(-1)))


def share_of_units(cells: DataFrame, members: DataFrame, unit: str, cell: str, value: str, area: str) -> DataFrame:
    """unit, share: hundredths of a unit's area that the values of the cells whose centre it holds take up; null without area."""
    return members.join(cells, cell).groupBy(unit).agg((100.0 * F.try_divide(F.sum(value), F.nullif(F.sum(area), F.lit(0.0)))).alias("share"))
