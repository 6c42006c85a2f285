"""Column expressions: missing values, scaling, labels, geometry on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = -9999
#: Mean earth radius in km.
EARTH_KM = 6371.0088
#: Column prefixes of variables that are stored times ten.
TIMES_TEN = ("tmp_dc_", "slp_dg_", "sgr_dk_")


def known(c: Column) -> Column:
    """Null for the sentinel and NaN; always applied before scaling."""
    d = c.cast("double")
    return F.when((d != NODATA) & ~F.isnan(d), d)


def descaled(c: Column, name: str) -> Column:
    return known(c) / 10 if name.startswith(TIMES_TEN) else known(c)


def delta(local: Column, upstream: Column) -> Column:
    """Local minus upstream; null if either is."""
    return known(local) - known(upstream)


def divergence(s: Column, u: Column) -> Column:
    """Hundredths by which upstream exceeds local, against the mean of their sizes; null if both are 0."""
    return F.try_divide(100 * (u - s), (F.abs(s) + F.abs(u)) / 2)


def in_range(c: Column, low: Column | int | float, high: Column | int | float) -> Column:
    """Closed interval."""
    return c.between(F.lit(low), F.lit(high))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))), F.lit(360.0))


def binned(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge that ``c`` lies below; the last label beyond all edges; null for null."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(c < edge, label).otherwise(out)
    return F.when(c.isNotNull(), out)


#: Aridity index classes, as hundredths, and by the published index classes.
ARIDITY_EDGES, ARIDITY_LABELS = [10.0, 20.0, 65.0, 100.0], ["hyper-arid", "arid", "semi-arid", "sub-humid", "humid"]
UNEP_EDGES, UNEP_LABELS = [0.05, 0.2, 0.5, 0.65], ["hyper-arid", "arid", "semi-arid", "dry sub-humid", "humid"]


def relief_position(elevation: Column, low: Column, high: Column) -> Column:
    """Share of the relief below the point, within 0 and 1; null without relief."""
    return F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(elevation - low, high - low))))


def qualifier(percentile: Column) -> Column:
    """How far from the middle: very from 35 points on, somewhat from 15, else typical."""
    far = F.abs(percentile - 50)
    return F.when(far >= 35, "very").when(far >= 15, "somewhat").otherwise("typical")


def pole(percentile: Column, low: str, high: str) -> Column:
    return F.when(percentile >= 50, high).otherwise(low)


def folded(name: Column) -> Column:
    """Name in lower case without accents, text in parentheses, signs and repeated spaces."""
    plain = F.translate(F.lower(name), "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\([^)]*\)", " "), r"[^a-z0-9]+", " "))


def slug(name: Column) -> Column:
    return F.replace(folded(name), F.lit(" "), F.lit("-"))


def lat_lon(text: Column) -> Column:
    """(lat, lon) of text like "12.5, -7"; null parts where it is something else."""
    number = r"([-+]?\d+(?:\.\d+)?)"
    whole = rf"^\s*{number}\s*,\s*{number}\s*$"
    return F.struct(*(F.regexp_extract(text, whole, i).try_cast("double").alias(n) for i, n in ((1, "lat"), (2, "lon"))))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    teen = (n % 100).between(11, 13)
    end = F.when(~teen & (n % 10 == 1), "st").when(~teen & (n % 10 == 2), "nd").when(~teen & (n % 10 == 3), "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


#: Numbers that are written as words.
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def number_word(n: Column) -> Column:
    """A whole number as a word up to ten, else digits in groups of three."""
    return F.when(n.between(0, 10), F.element_at(F.array(*map(F.lit, NUMBERS)), F.greatest(F.lit(1), F.least(F.lit(11), n.cast("int") + 1)))).otherwise(F.format_number(n, 0))


def year_label(year: Column) -> Column:
    """Years before 1 in BCE of the astronomical count."""
    return F.when(year < 1, F.concat((1 - year).cast("string"), F.lit(" BCE"))).otherwise(F.concat(year.cast("string"), F.lit(" CE")))


class NotAllowed(ValueError):
    """A parameter that isn't one of its allowed values."""


def one_of(value: str, allowed: list[str] | tuple[str, ...], name: str) -> str:
    """``value``, if it is allowed; else NotAllowed names the parameter and what it may be."""
    if value not in allowed:
        raise NotAllowed(f"{name} is {value!r}, not one of {', '.join(allowed)}")
    return value
