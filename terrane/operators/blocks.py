"""Aggregation blocks of a signature.

Input is long: one row for each query, unit and variable with the unit's weight in the query. Queries are rows, so any
number of them is one plan: each block groups by (query, variable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import dispersion, weighted

#: Zero share that makes a variable zero-aware, weight at zero that takes an area out of its domain, share
#: that makes a class mixture concentrated, least share of a listed class, coverage below which a mixture is marked.
ZERO_AWARE, OUTSIDE, PLURALITY, LEAST_SHARE, LOW_COVERAGE = 0.20, 0.90, 0.85, 1e-6, 0.50
#: Aggregation by kind of variable and by how its pattern changes with scale.
AREA_WEIGHTED = ("continental-gradient", "scale-dependent", "local-anomaly")
NETWORK = "network-topology"
#: Fixed labels of outlet types, as 10 * endorheic class + coast flag.
OUTLETS = {0: "inland, drains onward", 1: "coastal outlet", 10: "endorheic sink", 20: "endorheic, drains to a sink"}


def dispatch(kind: Column, cluster: Column) -> Column:
    """Name of the block that a catalog row's variable goes to."""
    return (
        F.when(kind == "categorical", "class_mixture")
        .when(kind == "flag", "flag_fraction")
        .when(cluster.isNull(), "distribution_only")
        .when(cluster.isin(*AREA_WEIGHTED), "area_weighted")
        .when(cluster == NETWORK, "dominant_unit")
        .otherwise("unknown")
    )


def area_weighted(rows: DataFrame, query: str = "query_id", unit: str = "unit_id", zero_fraction: str | None = None) -> DataFrame:
    """Rows: query, unit, variable, weight, score [, raw, the variable's zero fraction]. Result, by query and variable: status,
    n_units, coverage, representative_score, p10, p25, p75, p90, spread, iqr, weight_at_zero, core window, coherence.

    Scores are null where data are missing; weights are renormalised over the rest. A zero-aware variable whose weight at
    score 0 reaches OUTSIDE is outside its domain and loses score and tag.
    """
    keys = [query, "variable"]
    # windows, sums, quantiles and dispersion come from one shuffle and sort by query and variable
    q = {"p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90}
    known = F.col("score").isNotNull()
    one = dispersion.folded(weighted.pooled(rows, keys, unit, "score", "weight"), keys, "score", [
        *weighted.quantile_parts("score", q),
        ("coverage", weighted.coverage("score", "weight"), "sum"),
        ("_sum", F.sum(F.when(known, F.col("weight") * F.col("score"))), "sum"), ("_weight", F.sum(F.when(known, F.col("weight"))), "sum"),
        ("weight_at_zero", F.sum(F.when(F.col("score") == 0, F.col("weight")).otherwise(0.0)), "sum"),
        ("zero_fraction", F.max(zero_fraction) if zero_fraction else F.max(F.lit(None).cast("double")), "max"),
        ("n_units", F.count("w"), "sum"), ("tie", F.max("tie"), "max"),
    ])
    out = dispersion.tagged(one.select("*", *weighted.from_parts(q), F.try_divide("_sum", "_weight").alias("mean")))
    outside = F.coalesce((F.col("zero_fraction") >= ZERO_AWARE) & (F.col("weight_at_zero") >= OUTSIDE), F.lit(False))
    status = F.when(F.coalesce(F.col("coverage"), F.lit(0.0)) < 1e-9, "no_data").when(outside, "outside_active_domain").otherwise("ok")
    ok = status == "ok"
    return out.select(
        *keys,
        F.lit("area_weighted").alias("method"),
        status.alias("status"),
        F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"),
        "coverage",
        F.when(ok, F.col("mean")).alias("representative_score"),
        "p10",
        "p25",
        "p75",
        "p90",
        (F.col("p90") - F.col("p10")).alias("spread"),
        (F.col("p75") - F.col("p25")).alias("iqr"),
        "weight_at_zero",
        "core_share",
        "window_lo",
        "window_hi",
        F.when(ok, F.col("coherence")).alias("coherence"),
    )


def distribution_only(rows: DataFrame, query: str = "query_id", unit: str = "unit_id") -> DataFrame:
    """As area_weighted, for variables without a domain guard."""
    return area_weighted(rows, query, unit).withColumn("method", F.lit("distribution_only"))


def dominant_unit(rows: DataFrame, by: str, values: list[str], query: str = "query_id", unit: str = "unit_id", least: str | None = None) -> DataFrame:
    """The unit with the largest ``by`` (ties to the smaller id) gives all ``values``; n_units counts the whole set. With ``least``,
    the one of them that is the lowest of a year, ``perennial`` tells whether it is above 0."""
    top = F.max_by(F.struct(F.col(unit).alias("unit"), *values), F.struct(F.coalesce(F.col(by), F.lit(float("-inf"))), -F.col(unit)))
    picked = rows.groupBy(query).agg(top.alias("top"), F.count("*").alias("n_units"))
    return picked.select(query, F.lit("dominant_unit").alias("method"), "n_units", F.col("top.unit").alias("dominant_id"), *(F.col(f"top.{v}").alias(v) for v in values), *([(F.col(f"top.{least}") > 0).alias("perennial")] if least else []))


def class_mixture(rows: DataFrame, label: str = "label", query: str = "query_id", keys: list[str] | None = None) -> DataFrame:
    """Shares of classes: modal class and share, number, concentration, coverage, status, coherence and the listed mixture.

    Units without a label drop out, of the count too, and shares are of the rest; classes below LEAST_SHARE aren't listed.
    """
    on = [query, *(keys or [])]
    whole = rows.groupBy(*on).agg(F.sum(F.when(F.col(label).isNotNull(), F.col("weight")).otherwise(0.0)).alias("coverage"), F.count(label).alias("n_units"))
    parts = weighted.shares(rows, on, label, "weight", least=LEAST_SHARE)
    listed = parts.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("k"), F.col(label).alias("class_label")))).alias("m"))
    listed = listed.select(*on, F.transform("m", lambda x: F.struct(x["class_label"].alias("class_label"), (-x["k"]).alias("weight"))).alias("mixture"))
    out = whole.join(weighted.mixture(parts, on, label), on, "left").join(listed, on, "left")
    status = F.when(F.col("coverage") < 1e-9, "no_data").when(F.col("coverage") < LOW_COVERAGE, "low_coverage").otherwise("ok")
    return out.select(
        *on, F.lit("class_mixture").alias("method"), status.alias("status"), "n_units", "coverage", "modal_class", "modal_share", "n_classes", "concentration",
        F.when(F.col("modal_share") >= PLURALITY, "concentrated").when(F.col("modal_share").isNotNull(), "mixed").alias("coherence"), "mixture",
    )


def outlet_types(rows: DataFrame, endo: str, coast: str, query: str = "query_id") -> DataFrame:
    """query, outlet_id, outlet_type, share (of the query, not renormalised). A coastal endorheic unit is an error."""
    bad = (F.col(endo) >= 1) & (F.col(coast) == 1)
    code = F.when(bad, F.raise_error(F.lit("an endorheic unit can't be coastal")).cast("int")).otherwise((F.col(endo) * 10 + F.col(coast)).cast("int"))
    names = F.create_map(*(F.lit(x) for kv in OUTLETS.items() for x in kv))
    parts = rows.withColumn("outlet_id", code).groupBy(query, "outlet_id").agg(F.sum("weight").alias("share"))
    return parts.where(F.col("share") >= LEAST_SHARE).withColumn("outlet_type", names[F.col("outlet_id")])


def flag_fraction(rows: DataFrame, flag: str, query: str = "query_id") -> DataFrame:
    """query, n_units, fraction: weight of the flagged units."""
    return rows.groupBy(query).agg(F.count("*").alias("n_units"), F.sum(F.col(flag) * F.col("weight")).alias("fraction"))


def backfill_single(signature: DataFrame, raws: DataFrame, query: str = "query_id") -> DataFrame:
    """For a query of one unit, the unit's raw value stands for the area and the tag goes; other rows stay."""
    on = [query, "variable"]
    single = (F.col("n_units") == 1) & (F.col("status") == "ok")
    out = signature.join(raws.select(*on, F.col("raw").alias("_raw")), on, "left")
    return out.withColumn("representative_raw", F.when(single, F.round("_raw", 3))).withColumn("coherence", F.when(~single, F.col("coherence"))).drop("_raw")


def apply_modality(signature: DataFrame, modes: DataFrame, query: str = "query_id") -> DataFrame:
    """Where two regimes are found the score is withheld, kept as suppressed_score, and the regimes are listed."""
    on = [query, "variable"]
    two = F.col("modality") == "two_regime"
    out = signature.join(modes, on, "left")
    regimes = F.array(
        F.struct(F.lit(1).alias("id"), F.col("low_center").alias("center"), F.col("low_weight").alias("weight")),
        F.struct(F.lit(2).alias("id"), F.col("high_center").alias("center"), (1 - F.col("low_weight")).alias("weight")),
    )
    return out.select(
        *(c for c in signature.columns if c != "representative_score"),
        "modality",
        F.when(~F.coalesce(two, F.lit(False)), F.col("representative_score")).alias("representative_score"),
        F.when(two, F.col("representative_score")).alias("suppressed_score"),
        F.when(two, regimes).alias("regimes"),
    )


def payload(rows: DataFrame, scope: str, caveats: dict[str, str], query: str = "query_id", detail: list[str] | None = None) -> DataFrame:
    """One JSON document for each query: scope, its rows in order of variable, and each caveat's text once.

    Rows need the columns of an envelope plus ``caveat`` (array of keys); ``detail`` names the columns that only the detailed
    form has.
    """
    fields = [c for c in rows.columns if c != query and c not in (detail or [])]
    body = F.array_sort(F.collect_list(F.struct("variable", *(c for c in fields if c != "variable"))))
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_list("caveat"))))
    texts = F.create_map(*(F.lit(x) for kv in caveats.items() for x in kv)) if caveats else F.create_map().cast("map<string,string>")
    packed = rows.groupBy(query).agg(body.alias("rows"), keys.alias("_c"))
    doc = F.struct(F.lit(scope).alias("scope"), F.transform("_c", lambda k: F.struct(k.alias("key"), texts[k].alias("text"))).alias("caveats"), F.col("rows"))
    return packed.select(query, F.to_json(doc).alias("payload"))


def projected(rows: DataFrame, detail: list[str], with_detail: bool = False) -> DataFrame:
    """Signature rows in their lean form, without the columns ``detail``, or in full, with those as one struct of that name."""
    lean = rows.drop(*detail)
    return rows.select(*lean.columns, F.struct(*detail).alias("detail")) if with_detail else lean


def companions(rows: DataFrame, query: str = "query_id", unit: str = "unit_id") -> DataFrame:
    """query, variable, unit, weight, score: the units behind each figure that have a value, weights to six and scores to four
    places."""
    return rows.where(F.col("score").isNotNull()).select(query, "variable", unit, F.round("weight", 6).alias("weight"), F.round("score", 4).alias("score"))


def band_filter(rows: DataFrame, bands: str) -> DataFrame:
    """Rows of the bands named by letter, after all blocks have run."""
    wanted = sorted({b for b in bands.upper() if b.isalpha()})
    if not wanted or not set(wanted) <= set("ABCDET"):
        raise ValueError(f"bands are letters of ABCDET, not {bands!r}")
    return rows.where(F.col("band").isin(*wanted))


def diff(actual: DataFrame, reference: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """Cells in which two frames with the same keys differ: keys, column, actual, reference. Nulls and NaN are equal; rows of
    one side alone have the column "(row)"."""
    names = [c for c in actual.columns if c not in keys]
    if sorted(names) != sorted(c for c in reference.columns if c not in keys):
        raise ValueError("the frames' columns differ")
    a = actual.select(*keys, F.struct(*names).alias("_a"), F.lit(True).alias("_in_a"))
    b = reference.select(*keys, F.struct(*names).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, keys, "full")

    def cell(c: str) -> Column:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        if actual.schema[c].dataType.typeName() in ("double", "float", "integer", "long", "short", "byte"):
            x, y = F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.nanvl(y.cast("double"), F.lit(None).cast("double"))
            same = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        else:
            same = x.eqNullSafe(y)
        return F.when(~same, F.struct(F.lit(c).alias("column"), x.cast("string").alias("actual"), y.cast("string").alias("reference")))

    alone = F.array(F.struct(F.lit("(row)").alias("column"), F.col("_in_a").cast("string").alias("actual"), F.col("_in_b").cast("string").alias("reference")))
    cells = F.when(F.col("_in_a").isNull() | F.col("_in_b").isNull(), alone).otherwise(F.filter(F.array(*map(cell, names)), lambda x: x.isNotNull()))
    return both.select(*keys, F.inline(cells))

