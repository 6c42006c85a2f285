"""Joins and lookups that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; beyond that the join is by shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; its count stops at that bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stated(df: DataFrame, what: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` for broadcast; an error if it has more than ``rows`` rows. For sides that an operator compares with everything."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"{what}: more than {rows} rows; ask for them in blocks")
    return F.broadcast(df)


def both_ways(edges: DataFrame, a: str, b: str, other: list[str]) -> DataFrame:
    """An upper-triangle pair table seen from either end: (node, neighbour, other ...)."""
    ways = F.array(*(F.struct(F.col(x).alias("node"), F.col(y).alias("neighbour")) for x, y in ((a, b), (b, a))))
    return edges.select(F.inline(ways), *other)


def floor_lookup(queries: DataFrame, steps: DataFrame, at: str, step: str, key: str, values: list[str]) -> DataFrame:
    """Each query row with the values of its key's last step at or before ``at``; nulls if there is none.

    Queries and steps are merged into one ordered stream per key and the last step is carried forward, so nothing is joined
    pair by pair.
    """
    own = queries.columns
    q = queries.withColumn("_t", F.col(at)).withColumn("_q", F.lit(1)).withColumn("_s", F.lit(None).cast(steps.select(F.struct(step, *values).alias("x")).schema["x"].dataType))
    s = steps.select(F.col(key), F.col(step).alias("_t"), F.lit(0).alias("_q"), F.struct(step, *values).alias("_s"))
    order = Window.partitionBy(key).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    merged = q.unionByName(s, allowMissingColumns=True).withColumn("_last", F.last("_s", ignorenulls=True).over(order))
    return merged.where("_q = 1").select(*own, *(F.col(f"_last.{c}").alias(c) for c in (step, *values)))


def span_lookup(queries: DataFrame, steps: DataFrame, low: str, high: str, step: str, keys: list[str], values: list[str]) -> DataFrame:
    """Each query row's first step within [low, high], or else the step nearest to the span, ties to the earlier."""
    own = queries.columns
    inside = F.col(step).between(F.col(low), F.col(high))
    away = F.when(inside, 0).when(F.col(step) < F.col(low), F.col(low) - F.col(step)).otherwise(F.col(step) - F.col(high))
    q = queries.withColumn("_row", F.monotonically_increasing_id())
    near = q.join(small(steps.select(*keys, step, *values)), keys)
    best = near.groupBy("_row").agg(F.min_by(F.struct(step, *values, inside.alias("_in")), F.struct((~inside).cast("int"), away, F.col(step))).alias("_b"))
    return q.join(best, "_row", "left").select(*own, *(F.col(f"_b.{c}").alias(c) for c in (step, *values)), F.col("_b._in").alias("in_span"))


def valid_at(queries: DataFrame, slices: DataFrame, at: str, low: str, high: str, key: str, unit: str) -> DataFrame:
    """Each query's slice of its key whose closed span holds ``at``: the narrowest, then the smallest ``unit``."""
    q = queries.withColumn("_row", F.monotonically_increasing_id())
    hits = q.join(slices, key).where(F.col(at).between(F.col(low), F.col(high)))
    pick = Window.partitionBy("_row").orderBy(F.col(high) - F.col(low), unit)
    return hits.withColumn("_n", F.row_number().over(pick)).where("_n = 1").drop("_n", "_row")


def valid_or_nearest(queries: DataFrame, slices: DataFrame, at: str, low: str, high: str, key: str, unit: str) -> DataFrame:
    """As valid_at, or else the slice whose start is nearest, ties to the earlier; ``exact`` tells which."""
    q = queries.withColumn("_row", F.monotonically_increasing_id())
    hits = q.join(slices, key).withColumn("exact", F.col(at).between(F.col(low), F.col(high)))
    far = F.when(F.col("exact"), F.col(high) - F.col(low)).otherwise(F.abs(F.col(low) - F.col(at)))
    pick = Window.partitionBy("_row").orderBy(F.desc("exact"), far, low, unit)
    return hits.withColumn("_n", F.row_number().over(pick)).where("_n = 1").drop("_n", "_row")


def islands(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Adds ``island``: a number that grows by one wherever the state differs from the row before (null equals null)."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w) == 1
    changed = (first | ~F.lag(state).over(w).eqNullSafe(F.col(state))).cast("int")
    return df.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def top_or_other(df: DataFrame, keys: list[str], label: str, n: int, other: str = "Other") -> DataFrame:
    """Counts of the ``n`` most frequent labels by key and of all others together: keys, label, n_rows, rank."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*[F.col(k) for k in keys], F.lit(0)).orderBy(F.desc("_n"), label))
    named = counts.withColumn("_r", rank).withColumn("_l", F.when(F.col("_r") <= n, F.col(label)).otherwise(other)).withColumn("rank", F.least("_r", F.lit(n + 1)))
    return named.groupBy(*keys, F.col("_l").alias(label), "rank").agg(F.sum("_n").alias("n_rows"))


def prefer_present(rows: DataFrame, key: str, name: str, number: str, text: str, unknown: list[str]) -> DataFrame:
    """One value for each key and name: the largest number, or else the least text that isn't one of ``unknown``."""
    good = F.when(~F.lower(F.col(text)).isin(*unknown), F.col(text))
    return rows.groupBy(key, name).agg(F.max(number).alias("number"), F.min(good).alias("text"))


def tiered_match(queries: DataFrame, names: DataFrame, query: str, tiers: list[tuple[str, dict[str, str]]], name_id: str) -> DataFrame:
    """Each query's match in the first tier that has any: query, tier, name_id (the smallest). A tier is a label and the columns
    of the queries that must equal columns of the names. Names are first brought down to the smallest for each combination, so a
    query meets one row for each tier."""
    found = None
    for k, (label, equal) in enumerate(tiers):
        keys = [f"_k{i}" for i in range(len(equal))]
        least = names.groupBy(*(F.col(n).alias(x) for n, x in zip(equal.values(), keys, strict=True))).agg(F.min(name_id).alias(name_id))
        asked = queries.select(query, *(F.col(q).alias(x) for q, x in zip(equal, keys, strict=True)))
        part = asked.join(least, keys).select(query, F.lit(k).alias("_k"), F.lit(label).alias("tier"), name_id)
        found = part if found is None else found.unionByName(part)
    return found.groupBy(query).agg(F.min(F.struct("_k", "tier", name_id)).alias("_m")).select(query, "_m.tier", F.col(f"_m.{name_id}").alias(name_id))


def upsert_new(target: DataFrame | None, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys the target lacks, one for each key; appending them is an insert that ignores conflicts."""
    fresh = rows if target is None else rows.join(target.select(*keys), keys, "left_anti")
    return fresh.dropDuplicates(keys)


def keep_last(batches: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """Each key's row of the last batch; a null batch is the earliest, and of rows of one batch the largest stays. A grouped
    maximum, so a key with many batches sends a row for each task."""
    rest = [c for c in batches.columns if c not in (*keys, batch)]
    last = batches.groupBy(*keys).agg(F.max(F.struct(batch, *rest)).alias("_last"))
    return last.select(*(F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in batches.columns))


def first_box(df: DataFrame, lat: str, lon: str, boxes: list[tuple[str, float, float, float, float]]) -> Column:
    """Name of the first box (name, west, south, east, north) in the list's order that holds the point."""
    return F.coalesce(*(F.when(F.col(lon).between(w, e) & F.col(lat).between(s, n), name) for name, w, s, e, n in boxes))


def nearest_value(queries: DataFrame, points: DataFrame, key: str, at: str, value: str, point: str, names: list[str]) -> DataFrame:
    """Each query row (columns ``names``, key, at) with the point of its key whose value is nearest: point, away; ties to the
    smaller point. Both sides are merged into one ordered stream per key, in which the nearest points are the last one before
    and the first one after, so nothing is joined pair by pair."""
    p = points.groupBy(key, F.col(value).alias("_t")).agg(F.min(point).alias("_p")).withColumn("_q", F.lit(0))
    q = queries.select(*names, key, F.col(at).alias("_t"), F.lit(1).alias("_q"))
    both = q.unionByName(p, allowMissingColumns=True).withColumn("_s", F.when(F.col("_q") == 0, F.struct("_t", "_p")))
    order = Window.partitionBy(key).orderBy("_t", "_q")
    both = both.withColumn("_b", F.last("_s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the first one after is the last one before in the opposite order; a frame to the end would be gone through anew for each row
    back = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_q"))
    both = both.withColumn("_a", F.last("_s", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.filter(F.array("_b", "_a"), lambda x: x.isNotNull())
    best = F.array_min(F.transform(ends, lambda x: F.struct(F.abs(F.col("_t") - x["_t"]).alias("away"), x["_p"].alias("p"))))
    return both.where("_q = 1").withColumn("_m", best).where("_m IS NOT NULL").select(*names, key, F.col("_m.p").alias(point), F.col("_m.away").alias("away"))


def two_stage(df: DataFrame, keys: list[str], first: str, second: str, unit: str, candidates: int = 500, k: int = 10) -> DataFrame:
    """The ``k`` best by ``second`` among the ``candidates`` best by ``first``, both falling, ties to the smaller unit: rank."""
    some = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(first), unit))).where(F.col("_r") <= candidates).drop("_r")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(second), unit))).where(F.col("rank") <= k)


def best_row(df: DataFrame, keys: list[str], by: str, unit: str, values: list[str]) -> DataFrame:
    """Each group's row with the largest ``by``, ties to the smaller unit: keys, unit, values."""
    top = df.groupBy(*keys).agg(F.max_by(F.struct(unit, *values), F.struct(by, -F.col(unit))).alias("_b"))
    return top.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in (unit, *values)))


def per_stratum(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """The same number of rows of every stratum, the first ones by ``order``; weight is the stratum's size over the rows taken."""
    size = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    taken = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    return taken.join(size, stratum).withColumn("weight", F.col("_size") / F.least("_size", F.lit(n))).drop("_size")


def merged_sources(first: DataFrame, second: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row for each key of either source: the first source's values where it has them, else the second's; source tells which
    ones hold the key."""
    a = first.select(key, *(F.col(v).alias(f"_a_{v}") for v in values), F.lit(True).alias("_in_a"))
    b = second.select(key, *(F.col(v).alias(f"_b_{v}") for v in values), F.lit(True).alias("_in_b"))
    source = F.when(F.col("_in_a") & F.col("_in_b"), "both").when(F.col("_in_a"), "first").otherwise("second")
    return a.join(b, key, "full").select(key, *(F.coalesce(f"_a_{v}", f"_b_{v}").alias(v) for v in values), source.alias("source"))
