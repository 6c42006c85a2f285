"""Expressions on twelve-month curves (arrays of doubles). All stay inside the JVM."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _waves(n: int, k: int) -> tuple[Column, Column]:
    t = [2 * pi * k * m / n for m in range(n)]
    return F.array(*(F.lit(cos(x)) for x in t)), F.array(*(F.lit(sin(x)) for x in t))


def usable(a: Column, n: int = 12) -> Column:
    """A whole curve of finite values whose total is above 0."""
    return (F.size(a) == n) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x)) & (total(a) > 0)


def harmonics(a: Column, n: int = 12) -> Column:
    """Annual and semi-annual harmonics a1, b1, a2, b2 as shares of the total, and the log of one plus the total."""
    whole, parts = total(a), []
    for k in (1, 2):
        c, s = _waves(n, k)
        parts += [F.try_divide(dot(a, c), whole).alias(f"a{k}"), F.try_divide(dot(a, s), whole).alias(f"b{k}")]
    return F.struct(*parts, F.log1p(whole).alias("log_total"))


def concentration(a: Column, n: int = 12, k: int = 1) -> Column:
    """Length of the mean vector on the circle, 0 for a uniform curve and 1 for a single month; ``k`` = 2 doubles angles."""
    c, s = _waves(n, k)
    return F.try_divide(F.sqrt(F.pow(dot(a, c), 2) + F.pow(dot(a, s), 2)), total(a))


def peak_month(a: Column, n: int = 12) -> Column:
    """Direction of the mean vector in months, in [0, n)."""
    c, s = _waves(n, 1)
    return F.pmod(F.atan2(dot(a, s), dot(a, c)) / (2 * pi) * n, F.lit(float(n)))


def phase_offset(a: Column, b: Column, n: int = 12) -> Column:
    """Months between two peaks along the shorter way."""
    d = F.abs(peak_month(a, n) - peak_month(b, n))
    return F.least(d, n - d)


def cv(a: Column) -> Column:
    """Population standard deviation over the mean."""
    m = mean(a)
    return F.try_divide(F.sqrt(total(F.transform(a, lambda x: F.pow(x - m, 2))) / F.size(a)), m)


def centred_unit(a: Column) -> Column:
    """Less the mean, over the norm; null for a flat curve."""
    m = mean(a)
    c = F.transform(a, lambda x: x - m)
    norm = F.sqrt(dot(c, c))
    return F.when(norm > 0, F.transform(c, lambda x: x / norm))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two curves; null where either is flat."""
    ma, mb = mean(a), mean(b)
    sab = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    saa, sbb = total(F.transform(a, lambda x: F.pow(x - ma, 2))), total(F.transform(b, lambda x: F.pow(x - mb, 2)))
    return F.try_divide(sab, F.sqrt(saa * sbb))


def chord(r: Column) -> Column:
    """Distance of two unit curves with correlation r."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - r)))


def shifted(a: Column, by: Column | int) -> Column:
    """The curve turned ``by`` places to the left."""
    b = F.lit(by) if isinstance(by, int) else by
    return F.concat(F.slice(a, b + 1, F.size(a) - b), F.slice(a, F.lit(1), b))


def reconstruction(a: Column, n: int = 12) -> Column:
    """Two-harmonic curve with the same mean, cut off at 0."""
    m, terms = mean(a), []
    for k in (1, 2):
        c, s = _waves(n, k)
        terms.append((dot(a, c) * 2 / n, dot(a, s) * 2 / n))
    value = lambda t: m + sum((ca * F.cos(2 * pi * k * t / n) + sa * F.sin(2 * pi * k * t / n) for k, (ca, sa) in enumerate(terms, 1)), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.greatest(F.lit(0.0), value(t)))


def circular_peaks(a: Column, least: float, n: int = 12) -> Column:
    """Local maxima of a circular curve as (month from 0, value, prominence), those of at least ``least`` prominence.

    A place is a maximum if neither neighbour is higher and one is lower. Its prominence is its height above the higher of the
    two lowest values met on the way left and right until the curve exceeds the peak, or once around.
    """
    twice = F.concat(a, a)

    def floor(way: Column, top: Column) -> Column:
        start = F.struct(F.lit(float("inf")).alias("low"), F.lit(True).alias("on"))
        step = lambda s, x: F.struct(F.when(s["on"] & (x <= top), F.least(s["low"], x)).otherwise(s["low"]).alias("low"), (s["on"] & (x <= top)).alias("on"))
        return F.aggregate(way, start, step, lambda s: s["low"])

    def peak(i: Column) -> Column:
        top, left, right = F.get(a, i), F.get(a, F.pmod(i - 1, F.lit(n))), F.get(a, F.pmod(i + 1, F.lit(n)))
        here = (top >= left) & (top >= right) & ((top > left) | (top > right))
        prominence = top - F.greatest(floor(F.reverse(F.slice(twice, i + 1, F.lit(n))), top), floor(F.slice(twice, i + 2, F.lit(n)), top))
        return F.struct(i.alias("month"), top.alias("value"), F.when(here, prominence).alias("prominence"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), peak), lambda p: p["prominence"] >= least)
