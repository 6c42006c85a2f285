"""Entry points: weighted sets of units for many queries, and all blocks of their signatures in one plan.

A set is rows (query_id, unit_id, weight, inside): the unit's share of the query and the share of the unit that lies inside.
Buffers, single units, rings, polygons and polities only differ in how their sets are resolved; their rows then go through
the same plan, with any number of queries of any kind in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.scalars import bearing
from terrane.operators import blocks, dispersion, geometry, lookup, shapes, weighted
from terrane.session import stored

#: Least weight of a stored crosswalk row, the level that has a crosswalk, sides of a unit's inside share that
#: count as marginal, fewest units for a coherence tag.
CROSSWALK_LEAST, CROSSWALK_LEVEL, HALF, FIFTH, COHERENT = 1e-4, 8, 0.5, 0.2, 5
#: Scopes in which a river network's values are not reported, and in which two regimes withhold the score.
NOT_AREAL, MODAL = ("polity",), ("buffer", "single_unit", "ring")


def resolve_polity(queries: DataFrame, slices: DataFrame, units: DataFrame, unit: str, least: float = 0.0) -> DataFrame:
    """query_id, slice, unit, weight, inside of queries (query_id, name, year) against slices (slice, name, low, high, ring or shape):
    the slice of that name whose closed span holds the year, the narrowest and then the smallest, cut with the units (unit, ring
    or shape)."""
    at = lookup.valid_at(queries, slices.drop("ring", "shape"), "year", "low", "high", "name", "slice").select("query_id", "slice")
    # slices are cut once, however many queries ask for them
    cut = shapes.overlap_weights(units, slices.join(at.select("slice").distinct(), "slice", "left_semi"), unit, "slice", least=least)
    return at.join(cut, "slice").select("query_id", "slice", unit, "weight", F.col("unit_fraction").alias("inside"))


def resolve_crosswalk(queries: DataFrame, crosswalk: DataFrame, level: int = CROSSWALK_LEVEL, least: float = CROSSWALK_LEAST) -> DataFrame:
    """The stored sets of queries (query_id, polity): crosswalk rows of at least ``least`` weight with their place by falling
    weight. Other levels than CROSSWALK_LEVEL have none."""
    some = crosswalk.where((F.col("weight") >= least) & F.lit(level == CROSSWALK_LEVEL))
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "unit_id")
    return queries.join(some, "polity").withColumn("place", F.row_number().over(order))


def resolve_ring(queries: DataFrame, units: DataFrame, edges: DataFrame, unit: str) -> DataFrame:
    """Neighbours of the unit that covers each query's point: query_id, centre, neighbour, shared_km, border_bearing (from the
    centre's middle to the border's), centroid_bearing, place (by falling area).

    ``units``: (unit, ring or shape, area, lat, lon); ``edges``: (i, j, shared_km, mid_lat, mid_lon) for touching units, both ways, as
    ``outlines.touching`` gives them; a contact in points only has 0 shared km.
    """
    at = geometry.smallest_cover(queries, units, "lon", "lat", "query_id", unit).select("query_id", F.col(unit).alias("centre"))
    mid = units.select(F.col(unit).alias("centre"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    other = units.select(F.col(unit).alias("neighbour"), "area", F.col("lat").alias("_lb"), F.col("lon").alias("_mo"))
    ring = at.join(edges.withColumnRenamed("i", "centre").withColumnRenamed("j", "neighbour"), "centre").join(mid, "centre").join(other, "neighbour")
    order = Window.partitionBy("query_id").orderBy(F.desc("area"), "neighbour")
    return ring.select(
        "query_id", "centre", "neighbour", "shared_km", bearing(F.col("_la"), F.col("_lo"), F.col("mid_lat"), F.col("mid_lon")).alias("border_bearing"),
        bearing(F.col("_la"), F.col("_lo"), F.col("_lb"), F.col("_mo")).alias("centroid_bearing"), F.row_number().over(order).alias("place"),
    )


def resolve(units: DataFrame, unit: str, points: DataFrame | None = None, buffers: DataFrame | None = None, polygons: DataFrame | None = None, rings: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(query_id, member, scope, unit_id, weight, inside) of queries of any kind, for one signature plan.

    ``points`` (query_id, lat, lon) are single units; ``buffers`` (query_id, lat, lon, km) are cut from circles; ``polygons``
    (query_id, ring or shape) are cut as they are; ``rings`` (query_id, lat, lon) give the covering unit and each of its neighbours
    by itself, with the unit as ``member``, so a whole ring is a few rows and not a call for each. ``units`` has unit, ring or
    shape, and for rings area, lat and lon; ``edges`` are theirs. Queries that no unit covers have no row.
    """
    parts = []
    one = lambda df, scope, member: df.select("query_id", member.cast("long").alias("member"), F.lit(scope).alias("scope"), F.col(unit).alias("unit_id"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("inside"))
    cover = lambda df: geometry.smallest_cover(df, units, "lon", "lat", "query_id", unit)
    if points is not None:
        parts.append(one(cover(points), "single_unit", F.lit(None)))
    if rings is not None:
        ring = resolve_ring(rings, units, edges, unit)
        members = ring.select("query_id", F.col("neighbour").alias(unit)).unionByName(ring.select("query_id", F.col("centre").alias(unit)).distinct())
        parts.append(one(members, "ring", F.col(unit)))
    for areas, scope in ((polygons, "polygon"), (None if buffers is None else buffers.select("query_id", geometry.circle(F.col("lat"), F.col("lon"), F.col("km")).alias("ring")), "buffer")):
        if areas is not None:
            cut = shapes.overlap_weights(units, areas, unit, "query_id")
            parts.append(cut.select("query_id", F.lit(None).cast("long").alias("member"), F.lit(scope).alias("scope"), F.col(unit).alias("unit_id"), "weight", F.col("unit_fraction").alias("inside")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scope_of(sets: DataFrame) -> DataFrame:
    """query_id, n_units, shortfall (what the units leave of the query), lt_half and lt_fifth (weight of units less than half and
    less than a fifth inside)."""
    inside = lambda most: F.round(F.sum(F.when(F.col("inside") < most, F.col("weight")).otherwise(0.0)), 6)
    return sets.groupBy("query_id").agg(F.count("*").alias("n_units"), F.greatest(F.lit(0.0), F.round(1 - F.sum("weight"), 6)).alias("shortfall"), inside(HALF).alias("lt_half"), inside(FIFTH).alias("lt_fifth"))


def signatures(sets: DataFrame, scopes: DataFrame, scores: DataFrame, labels: DataFrame, flags: DataFrame, catalog: DataFrame, lead: str) -> DataFrame:
    """One row for each query and catalog variable: query_id, scope, variable, band, method, status, n_units, coverage,
    representative_score, representative_raw, modal_class, suppressed, coherence.

    ``scores`` is (unit_id, variable, raw, score), ``labels`` (unit_id, variable, label), ``flags`` (unit_id, variable, flag),
    ``scopes`` (query_id, scope), ``catalog`` (variable, band, kind, cluster, zero_fraction), a small dimension. The variable
    ``lead`` chooses the dominant unit. Which block a variable goes to is the catalog's matter.
    """
    # written once: every block reads the same sets, and their scores
    sets, scopes = stored(sets), stored(scopes)
    named = F.broadcast(catalog.withColumn("method", blocks.dispatch(F.col("kind"), F.col("cluster"))))
    size = sets.groupBy("query_id").agg(F.count("*").alias("_units")).join(scopes, "query_id")
    rows = stored(sets.join(scores, "unit_id").join(named.select("variable", "band", "method", "zero_fraction"), "variable"))

    # area-weighted and distribution-only variables: all of their statistics from one shuffle
    keys = ["query_id", "variable"]
    areal = rows.where(F.col("method").isin("area_weighted", "distribution_only"))
    guarded = areal.withColumn("zero_fraction", F.when(F.col("method") == "area_weighted", F.col("zero_fraction")))
    mean = blocks.area_weighted(guarded, zero_fraction="zero_fraction").drop("method")
    modes = dispersion.modality(weighted.cumulated(areal, keys, "unit_id", "score", "weight"), keys, "score").select(*keys, "modality")
    alone = areal.groupBy(*keys).agg(F.first("method").alias("method"), F.first("band").alias("band"), F.max("raw").alias("_raw"))
    one = mean.join(alone, keys).join(modes, keys, "left").join(size, "query_id")
    ok = F.col("status") == "ok"
    two = ok & F.col("scope").isin(*MODAL) & F.coalesce(F.col("modality") == "two_regime", F.lit(False))
    none = lambda kind: F.lit(None).cast(kind)
    areal_rows = one.select(
        "query_id", "scope", "variable", "band", "method", "status", "n_units", "coverage", F.when(~two, F.col("representative_score")).alias("representative_score"),
        F.when(ok & (F.col("_units") == 1), F.round("_raw", 3)).alias("representative_raw"), none("string").alias("modal_class"), two.alias("suppressed"),
        F.when(F.col("_units") >= COHERENT, F.col("coherence")).alias("coherence"),
    )

    # the dominant unit gives all network variables
    by = F.max_by("unit_id", F.struct(F.coalesce("raw", F.lit(float("-inf"))), -F.col("unit_id")))
    top = rows.where(F.col("variable") == lead).groupBy("query_id").agg(by.alias("unit_id"))
    network = rows.where(F.col("method") == "dominant_unit").join(top, ["query_id", "unit_id"]).join(size, "query_id")
    areal_scope = ~F.col("scope").isin(*NOT_AREAL)
    status = F.when(~areal_scope, "not_areal").when(F.col("raw").isNull(), "no_data").otherwise("ok")
    network_rows = network.select(
        "query_id", "scope", "variable", "band", "method", status.alias("status"), F.col("_units").alias("n_units"), none("double").alias("coverage"), F.when(areal_scope, F.col("score")).alias("representative_score"),
        F.when(areal_scope, F.col("raw")).alias("representative_raw"), none("string").alias("modal_class"), F.lit(False).alias("suppressed"), none("string").alias("coherence"),
    )

    bands = named.select("variable", "band")
    mixed = blocks.class_mixture(sets.join(labels, "unit_id"), keys=["variable"]).join(bands, "variable").join(scopes, "query_id")
    class_rows = mixed.select(
        "query_id", "scope", "variable", "band", "method", "status", "n_units", "coverage", none("double").alias("representative_score"), none("double").alias("representative_raw"), "modal_class",
        F.lit(False).alias("suppressed"), "coherence",
    )
    parts = sets.join(flags, "unit_id").groupBy("query_id", "variable").agg(F.count("*").alias("n_units"), F.sum(F.col("flag") * F.col("weight")).alias("share"))
    flag_rows = parts.join(bands, "variable").join(scopes, "query_id").select(
        "query_id", "scope", "variable", "band", F.lit("flag_fraction").alias("method"), F.lit("ok").alias("status"), "n_units", none("double").alias("coverage"), none("double").alias("representative_score"),
        F.col("share").alias("representative_raw"), none("string").alias("modal_class"), F.lit(False).alias("suppressed"), none("string").alias("coherence"),
    )
    return areal_rows.unionByName(network_rows).unionByName(class_rows).unionByName(flag_rows)
