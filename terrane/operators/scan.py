"""Trait scans: how a group of records sits in the space of all records, and who is in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.scalars import haversine_km, pole, qualifier
from terrane.operators import geometry
from terrane.operators.lookup import small
from terrane.operators.position import neutral_long, placed, rank_share, value_ranks
from terrane.session import stored


def backdrop(df: DataFrame, features: list[str]) -> DataFrame:
    """Complete rows with their features as z-scores of the whole table (population deviation): z_<feature>."""
    whole = df.na.drop(subset=features)
    stats = F.broadcast(whole.agg(*(F.avg(f).alias(f"_m_{f}") for f in features), *(F.stddev_pop(f).alias(f"_s_{f}") for f in features)))
    z = [F.coalesce(F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.col(f"_s_{f}")), F.lit(0.0)).alias(f"z_{f}") for f in features]
    return whole.join(stats).select(*whole.columns, *z)


def cohesion(z: DataFrame, group: str, features: list[str]) -> DataFrame:
    """group, n, cohesion (mean distance to the group's centroid), displacement (the centroid's distance from the origin)."""
    names = [f"z_{f}" for f in features]
    centre = z.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"_c_{c}") for c in names))
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_c_{c}"), F.lit(2)) for c in names), F.lit(0.0)))
    out = F.sqrt(sum((F.pow(F.col(f"_c_{c}"), F.lit(2)) for c in names), F.lit(0.0)))
    return z.join(centre, group).withColumn("_d", d).groupBy(group).agg(F.first("n").alias("n"), F.avg("_d").alias("cohesion"), F.first(out).alias("displacement"))


def random_draws(z: DataFrame, unit: str, features: list[str], size: int, rounds: int = 200, seed: int = 0, within: DataFrame | None = None, family: str | None = None) -> DataFrame:
    """(round, cohesion, displacement) of seeded random sets of ``size`` rows; with ``within`` (family, k), each round takes k
    rows of every family instead. Draws are the first rows by a hash of unit and round."""
    some = z if within is None else z.where(F.col(family).isNotNull())
    rows = some.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_h", F.xxhash64(unit, "round", F.lit(seed)))
    # one distributed sort places the rows of all rounds; every round has the same rows, so a place tells the place in its round
    ranked = placed(rows, [F.col("round"), *([F.col(family)] if family and within is not None else []), F.col("_h"), F.col(unit)], "_at").withColumn("_at", F.pmod(F.col("_at") - 1, F.lit(max(1, some.count()))))
    if within is None:
        drawn = ranked.where(F.col("_at") < size)
    else:
        sizes = some.groupBy(family).agg(F.count("*").alias("_n"))  # a row for each family
        first = sizes.select(family, (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(family)) - F.col("_n")).alias("_first"))
        drawn = ranked.join(small(first.join(within, family)), family).where(F.col("_at") - F.col("_first") < F.col("k"))
    return cohesion(drawn, "round", features).select("round", "cohesion", "displacement")


def top_families(df: DataFrame, group: str, family: str, n: int = 3) -> DataFrame:
    """group, label, n_rows, share, kind: the n largest families, the other families together, and rows without one; empty
    parts are left out."""
    counts = df.groupBy(group, family).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(group, F.col(family).isNull()).orderBy(F.desc("_n"), family)
    kind = F.when(F.col(family).isNull(), "unresolved").when(F.row_number().over(order) <= n, "family").otherwise("other")
    named = counts.withColumn("kind", kind).withColumn("label", F.when(F.col("kind") == "family", F.col(family)).otherwise(F.col("kind")))
    parts = named.groupBy(group, "label", "kind").agg(F.sum("_n").alias("n_rows"))
    return parts.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(group)))


def variable_percentiles(df: DataFrame, focus: Column, features: dict[str, tuple[str, str]]) -> DataFrame:
    """variable, mean (of the focus rows), percentile (hundredths of all rows at most that mean), pole, qualifier."""
    means = F.broadcast(df.where(focus).agg(*(F.avg(f).alias(f"_f_{f}") for f in features)))
    at = [100.0 * F.avg(F.when(F.col(f).isNotNull(), (F.col(f) <= F.col(f"_f_{f}")).cast("double"))) for f in features]
    one = df.join(means).agg(*(p.alias(f"_p_{f}") for p, f in zip(at, features, strict=True)), *(F.first(f"_f_{f}").alias(f"_f_{f}") for f in features))
    rows = F.array(*(F.struct(F.lit(f).alias("variable"), F.col(f"_f_{f}").alias("mean"), F.col(f"_p_{f}").alias("percentile"), pole(F.col(f"_p_{f}"), *ends).alias("pole"), qualifier(F.col(f"_p_{f}")).alias("qualifier")) for f, ends in features.items()))
    return one.select(F.inline(rows))


def lens_observed(df: DataFrame, unit: str, focus: Column, lenses: dict[str, list[str]]) -> DataFrame:
    """lens, n_backdrop, n_focus, cohesion, displacement of the focus rows in each lens, a set of features: z-scores over the rows
    that have all of them; a lens without focus rows has nulls."""
    out = None
    for name, features in lenses.items():
        z = backdrop(df, features)
        n = z.agg(F.count("*").alias("n_backdrop"), F.count_if(F.coalesce(focus, F.lit(False))).alias("n_focus"))
        own = cohesion(z.where(focus).withColumn("_lens", F.lit(name)), "_lens", features)
        one = n.withColumn("_lens", F.lit(name)).join(own, "_lens", "left").select(F.col("_lens").alias("lens"), "n_backdrop", "n_focus", "cohesion", "displacement")
        out = one if out is None else out.unionByName(one)
    return out


def lens_distances(df: DataFrame, unit: str, focus: Column, lenses: dict[str, list[str]]) -> DataFrame:
    """lens, unit, distance of each focus row to the focus rows' centroid."""
    out = None
    for name, features in lenses.items():
        z = backdrop(df, features).where(focus)
        centre = F.broadcast(z.agg(*(F.avg(f"z_{f}").alias(f"_c_{f}") for f in features)))
        far = F.sqrt(sum((F.pow(F.col(f"z_{f}") - F.col(f"_c_{f}"), F.lit(2)) for f in features), F.lit(0.0)))
        one = z.join(centre).select(F.lit(name).alias("lens"), unit, far.alias("distance"))
        out = one if out is None else out.unionByName(one)
    return out


def lens_scan(df: DataFrame, unit: str, focus: Column, lenses: dict[str, list[str]], rounds: int = 200, seed: int = 0) -> DataFrame:
    """``lens_observed`` with pct_tighter (hundredths of random sets of as many rows whose distances are as large or larger),
    random_cohesion and random_displacement (means over the sets) and displacement_rank (hundredths of sets at most as far out)."""
    observed, out = stored(lens_observed(df, unit, focus, lenses)), None
    for r in observed.select("lens", "n_focus").collect():  # a row for each lens
        drawn = random_draws(stored(backdrop(df, lenses[r.lens]).select(unit, *(f"z_{f}" for f in lenses[r.lens]))), unit, lenses[r.lens], r.n_focus, rounds, seed) if r.n_focus else None
        one = observed.where(F.col("lens") == r.lens)
        if drawn is None:
            none = F.lit(None).cast("double")
            one = one.select("*", *(none.alias(c) for c in ("pct_tighter", "random_cohesion", "random_displacement", "displacement_rank")))
        else:
            named = drawn.select(F.col("cohesion").alias("_c"), F.col("displacement").alias("_d")).join(F.broadcast(one))
            one = named.groupBy(*one.columns).agg(
                (100 * F.avg((F.col("_c") >= F.col("cohesion")).cast("double"))).alias("pct_tighter"), F.avg("_c").alias("random_cohesion"), F.avg("_d").alias("random_displacement"),
                (100 * F.avg((F.col("_d") <= F.col("displacement")).cast("double"))).alias("displacement_rank"),
            )
        out = one if out is None else out.unionByName(one)
    return out


def ticks(df: DataFrame, unit: str, family: str, focus: Column, features: list[str]) -> DataFrame:
    """unit, family, variable, percentile of each focus row and variable that it has: hundredths by average rank among all rows
    with a value, so gaps in one variable leave the others alone. All variables are ranked in one plan."""
    scored = rank_share(neutral_long(df, unit, features), "raw", ["variable"], "percentile").where("percentile IS NOT NULL")
    return scored.join(df.where(focus).select(unit, family), unit).select(unit, family, "variable", "percentile")


def records(df: DataFrame, unit: str, family: str, trait: str, focus: Column, features: list[str], more: list[str]) -> DataFrame:
    """A row for each focus row: unit, ``more``, family, family_coded (rows of its family that the trait is coded for, in focus or
    not; null without a family), and p_<feature>, its percentiles as in ``ticks``."""
    coded = df.where(F.col(trait).isNotNull() & F.col(family).isNotNull()).groupBy(family).agg(F.count("*").alias("family_coded"))
    wide = ticks(df, unit, family, focus, features).groupBy(unit).agg(*(F.max(F.when(F.col("variable") == f, F.col("percentile"))).alias(f"p_{f}") for f in features))
    own = df.where(focus).select(unit, *more, family).join(coded, family, "left").join(wide, unit, "left")
    return own.select(unit, *more, family, F.when(F.col(family).isNotNull(), F.coalesce("family_coded", F.lit(0))).alias("family_coded"), *(f"p_{f}" for f in features))


def scatter(df: DataFrame, unit: str, focus: Column, x: str, y: str) -> DataFrame:
    """unit, x, y, side (focus or backdrop) of all rows with both values."""
    side = F.when(F.coalesce(focus, F.lit(False)), "focus").otherwise("backdrop")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(unit, F.col(x).alias("x"), F.col(y).alias("y"), side.alias("side"))


def isolates(df: DataFrame, unit: str, family: str, lat: str, lon: str, holder: Column, percentiles: list[str]) -> DataFrame:
    """Holders of a trait by how alone they are: unit, rarity (share of the own family that holds it), km (to the nearest
    holder of another family), environment (distance in percentiles to the nearest holder), their ranks, and the worst
    rank, by which rows are ordered. Unrelated rows are those of other families; rows without a family are unrelated to all. Units
    are unique. Nearest holders are looked for in cells, with reaches that double, so no list of all pairs is formed.
    """
    rate = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.avg(holder.cast("double")).alias("rarity"))
    held = stored(df.where(holder).select(F.col(unit).alias("u"), F.col(family).alias("f"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), *(F.col(p).cast("double").alias(f"e{k}") for k, p in enumerate(percentiles))))
    n, axes = max(1, held.count()), [f"e{k}" for k in range(len(percentiles))]

    def elsewhere(left: DataFrame, reach: float) -> DataFrame:
        met = geometry.meet(left, held.select("u", "f", "lat", "lon"), reach).where("q.u <> p.u AND (q.f IS NULL OR p.f IS NULL OR q.f <> p.f)")
        return met.select("q.u", haversine_km(F.col("q.lat"), F.col("q.lon"), F.col("p.lat"), F.col("p.lon")).alias("km")).groupBy("u").agg(F.min("km").alias("km"))

    def alike(left: DataFrame, reach: float) -> DataFrame:
        """Rows within reach of each other are in neighbouring cells of the first two percentiles."""
        cell = lambda c: F.floor(F.col(c) / reach)
        around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
        q, p = left.select(F.struct("u", *axes).alias("q"), *axes[:2]), held.select(F.struct("u", *axes).alias("p"), *axes[:2])
        for k, c in enumerate(axes[:2]):
            q, p = q.withColumn(f"_c{k}", around(c)), p.withColumn(f"_c{k}", cell(c))
        met = q.drop(*axes).join(p.drop(*axes), [f"_c{k}" for k in range(len(axes[:2]))]).where("q.u <> p.u")
        far = F.sqrt(sum((F.pow(F.col(f"q.{c}") - F.col(f"p.{c}"), F.lit(2)) for c in axes), F.lit(0.0)))
        return met.select("q.u", far.alias("environment")).groupBy("u").agg(F.min("environment").alias("environment"))

    # reaches that hold a few holders if they were spread evenly
    placed_ = held.where("lat IS NOT NULL AND lon IS NOT NULL").select("u", "f", "lat", "lon")
    km = geometry.widening(placed_, "u", elsewhere, max(1.0, 25_000 / n**0.5), geometry.HALF_GIRTH_KM)
    whole = held.select("u", *axes).na.drop()
    env = geometry.widening(whole, "u", alike, max(0.01, 250 / n**0.5), 100.0 * len(axes) ** 0.5 + 1, "environment")
    out = held.select(F.col("u").alias(unit), F.col("f").alias(family)).join(rate, family, "left").join(km.withColumnRenamed("u", unit), unit, "left").join(env.withColumnRenamed("u", unit), unit, "left")
    out = stored(out)
    # ranks by value, so that no task sorts all rows; rows without a value come last
    measures = (("rank_family", "rarity", 1.0), ("rank_km", "km", -1.0), ("rank_environment", "environment", -1.0))
    base = out.select("*", *(F.coalesce(sign * F.round(value, 9), F.lit(float("inf"))).alias(f"_{name}") for name, value, sign in measures))
    out = base
    for name, _, _ in measures:
        out = out.join(value_ranks(base, f"_{name}").select(f"_{name}", (F.col("n_below") + 1).alias(name)), f"_{name}")
    return out.withColumn("worst_rank", F.greatest("rank_family", "rank_km", "rank_environment")).select(unit, "rarity", "km", "environment", "rank_family", "rank_km", "rank_environment", "worst_rank")


def name_agreement(a: Column, b: Column) -> Column:
    """Whether two folded names share a token."""
    return F.arrays_overlap(F.split(a, " "), F.split(b, " "))


def edit_ratio(a: Column, b: Column) -> Column:
    """Hundredths: 100 less the edits per character of the longer name."""
    return 100.0 * (1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))))


def token_sort(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(name, " ")), " ")


def fuzzy_matches(names: DataFrame, titles: DataFrame, name: str, title: str, name_id: str, title_id: str, least: float = 85.0) -> DataFrame:
    """name_id, title_id, score, how: exact, without spaces, or the best of plain and token-sorted edit ratio of at least
    ``least`` among titles that share a token with the name; ties to the smaller title id. Names and titles are folded."""
    # equal names are matched once, and of equal titles only the smallest id can win
    a, own = names.select(F.col(name).alias("_a")).distinct(), names.select(name_id, F.col(name).alias("_a"))
    b = titles.groupBy(F.col(title).alias("_b")).agg(F.min(title_id).alias(title_id))
    exact = a.join(b, F.col("_a") == F.col("_b")).select("_a", title_id, F.lit(100.0).alias("score"), F.lit("exact").alias("how"))
    tight = a.join(b, F.replace("_a", F.lit(" "), F.lit("")) == F.replace("_b", F.lit(" "), F.lit(""))).select("_a", title_id, F.lit(99.0).alias("score"), F.lit("no space").alias("how"))
    tokens = a.withColumn("_t", F.explode(F.array_distinct(F.split("_a", " ")))).join(b.withColumn("_t", F.explode(F.array_distinct(F.split("_b", " ")))), "_t").select("_a", title_id, "_b").distinct()
    ratio = F.greatest(edit_ratio(F.col("_a"), F.col("_b")), edit_ratio(token_sort(F.col("_a")), token_sort(F.col("_b"))))
    loose = tokens.withColumn("score", F.least(F.lit(98.0), ratio)).where(F.col("score") >= least).select("_a", title_id, "score", F.lit("fuzzy").alias("how"))
    found = exact.unionByName(tight).unionByName(loose)
    best = found.groupBy("_a").agg(F.max(F.struct("score", (-F.col(title_id)).alias("t"), "how")).alias("m"))
    return own.join(best, "_a").select(name_id, (-F.col("m.t")).alias(title_id), "m.score", "m.how")
