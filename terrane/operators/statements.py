"""Statements derived from signature rows: each rule tells whether it applies, and why not if it doesn't.

A rule is an id, an ordered list of reasons for not applying, a statistic and a text; all rules of a family are columns of
one pass over the rows, unpivoted. Reasons are a word, or a word and the value that it is about.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.scalars import UNEP_EDGES, UNEP_LABELS, binned, ordinal

#: Zero share that makes a variable zero-aware, least share that is stated, units that a spread label takes,
#: classes that are listed, distance from either end that counts as a tail, eligible variables that a band and a query take.
ZERO_AWARE, FLOOR, COHERENT, LISTED, TAIL, BAND_LEAST, ALL_LEAST = 0.20, 0.01, 5, 3, 10, 3, 5
#: Methods whose rows carry a percentile of the area, and those that also do so for one unit.
CONTINUOUS = ("area_weighted", "distribution_only")
SINGLE = (*CONTINUOUS, "dominant_unit")

#: Columns of a signature row that rules read; a frame that lacks one is read as if it were null.
FIELDS = {
    "method": "string", "status": "string", "scope": "string", "area_units": "long", "n_units": "long", "representative_score": "double",
    "representative_raw": "double", "suppressed": "boolean", "weight_at_zero": "double", "coverage": "double", "zero_fraction": "double",
    "shortfall": "double", "lt_half": "double", "lt_fifth": "double", "core_share": "double", "window_lo": "int", "p10": "double", "p90": "double",
    "coherence": "string", "least": "double", "most": "double", "low_center": "double", "high_center": "double", "top_share": "double",
    "rest_share": "double", "n_classes": "long",
}


@dataclass(frozen=True)
class Rule:
    id: str
    unless: tuple[tuple[Column | str, Column], ...]
    """(reason, condition): the first condition that holds is why the rule doesn't apply."""
    stat: Column | None
    text: Column | str
    always: bool = False
    """The statistic is given even if the rule doesn't apply."""


def evaluate(rows: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """keys, rule, applies, reason, text, stat: one row for each rule and row."""
    known = rows.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in FIELDS.items() if c not in rows.columns))

    def one(r: Rule) -> Column:
        reason = F.lit(None).cast("string")
        for why, condition in reversed(r.unless):
            reason = F.when(F.coalesce(condition, F.lit(False)), F.lit(why) if isinstance(why, str) else why).otherwise(reason)
        ok = reason.isNull()
        stat = F.lit(None).cast("double") if r.stat is None else r.stat.cast("double")
        text = F.lit(r.text) if isinstance(r.text, str) else r.text
        return F.struct(F.lit(r.id).alias("rule"), ok.alias("applies"), reason.alias("reason"), F.when(ok, text).alias("text"), (stat if r.always else F.when(ok, stat)).alias("stat"))

    return known.select(*keys, F.inline(F.array(*map(one, rules))))


def _because(label: str, c: str) -> Column:
    return F.concat(F.lit(f"{label}:"), F.coalesce(F.col(c), F.lit("None")))


def _bad_status() -> tuple[Column, Column]:
    return _because("status", "status"), ~F.col("status").eqNullSafe("ok")


def _not_in(methods: tuple[str, ...]) -> tuple[Column, Column]:
    return _because("method", "method"), ~F.coalesce(F.col("method").isin(*methods), F.lit(False))


def _nth(c: str) -> Column:
    return ordinal(F.round(c).cast("int"))


def _percent(c: Column) -> Column:
    return F.concat(F.round(100 * c).cast("int").cast("string"), F.lit("%"))


def position_rules() -> list[Rule]:
    """Where a value stands: percentile of one unit or mean percentile of several, raw value, zero, share at the bottom."""
    s, raw, n = F.col("representative_score"), F.col("representative_raw"), F.col("area_units")
    one, zero = n.eqNullSafe(1), (raw == 0) & (s == 0)
    aware = F.coalesce(F.col("method").isin(*CONTINUOUS) & (F.col("zero_fraction") >= ZERO_AWARE), F.lit(False))
    single = (_not_in(SINGLE), _bad_status(), ("multi_unit", ~one))
    empty = ("no_value", raw.isNull() | s.isNull())
    area = (_not_in(CONTINUOUS), ("one_unit", one), _bad_status())
    bottom = F.col("weight_at_zero") / F.col("coverage")
    name, at = F.col("variable"), F.concat(_nth("representative_score"), F.lit(" percentile"))
    return [
        Rule("POS-01", (*single, empty, ("zero_value", zero), ("zero_aware_variable", aware)), s, F.concat(name, F.lit(": "), at)),
        Rule("POS-02", (*area, ("suppressed", F.col("suppressed")), ("no_value", s.isNull()), ("all_at_bottom", s == 0)), s, F.concat(name, F.lit(": mean of the units at the "), at)),
        Rule("POS-03", (*single, ("no_value", raw.isNull())), raw, F.concat(name, F.lit(": value "), raw.cast("string"))),
        Rule("POS-04", (*single, ("not_zero", ~F.coalesce(zero, F.lit(False)))), F.lit(0), F.concat(name, F.lit(": none in this unit"))),
        Rule("POS-05", (*single, ("not_zero_aware", ~aware), empty, ("zero_value", zero)), s, F.concat(name, F.lit(": among units that have any, "), at)),
        Rule("POS-06", (*area, ("no_weight", F.col("weight_at_zero").isNull() | ~F.coalesce(F.col("coverage") > 0, F.lit(False))), ("below_floor", bottom < FLOOR)), bottom, F.concat(name, F.lit(": at the bottom over "), _percent(bottom))),
        Rule("POS-07", (_not_in(("dominant_unit",)), ("one_unit", one), _bad_status(), empty), s, F.concat(name, F.lit(": in the leading unit, "), at)),
    ]


def empty_rules() -> list[Rule]:
    """Why a row has no percentile."""
    status, one = F.col("status"), F.col("area_units").eqNullSafe(1)
    other = lambda kind: (_because("status", "status"), ~status.eqNullSafe(kind))
    gap = F.col("high_center") - F.col("low_center")
    name = F.col("variable")
    return [
        Rule("EMP-01", (other("outside_active_domain"), ("multi_unit", ~one)), F.col("zero_fraction"), F.concat(name, F.lit(": zero here, without a percentile"))),
        Rule("EMP-02", (other("outside_active_domain"), ("one_unit", one), ("no_weight", F.col("weight_at_zero").isNull())), F.col("weight_at_zero"), F.concat(name, F.lit(": zero over "), _percent(F.col("weight_at_zero")))),
        Rule("EMP-03", (other("no_data"),), None, F.concat(name, F.lit(": the source has no value here"))),
        Rule("EMP-04", (other("not_areal"),), None, F.concat(name, F.lit(": of a river network, not of an area"))),
        Rule("EMP-05", (other("low_coverage"),), F.col("coverage"), F.concat(name, F.lit(": known for "), _percent(F.col("coverage")))),
        Rule("EMP-06", (_bad_status(), ("not_suppressed", ~F.coalesce("suppressed", F.lit(False))), ("no_regimes", gap.isNull())), gap, F.concat(name, F.lit(": two groups, no single percentile"))),
    ]


def coverage_rules() -> list[Rule]:
    """How much of a query the figures describe; rows are queries."""
    one = ("single_unit", F.col("scope") == "single_unit")
    n, short = F.col("area_units"), F.coalesce("shortfall", F.lit(0.0))
    return [
        Rule("COV-01", (one, ("below_floor", short < FLOOR)), F.when(F.col("scope") != "single_unit", short), F.concat(_percent(short), F.lit(" lies outside any unit")), always=True),
        Rule("COV-02", (one,), n, F.concat(F.lit("units described: "), n.cast("string"))),
        Rule("COV-04", ((_because("scope", "scope"), F.col("scope") != "polity"), ("no_field", F.col("lt_half").isNull())), F.col("lt_half"), F.concat(F.lit("units less than half inside carry "), _percent(F.col("lt_half")))),
    ]


def row_coverage_rules() -> list[Rule]:
    """How many of the query's units a variable's figure rests on."""
    k, n, cov, short = F.col("n_units"), F.col("area_units"), F.col("coverage"), F.coalesce("shortfall", F.lit(0.0))
    no = (("single_unit", F.col("scope") == "single_unit"), (_because("method", "method"), F.col("method") == "dominant_unit"), _bad_status())
    share = F.try_divide(cov, 1 - short)
    missing = k.isNull() | cov.isNull() | n.isNull() | (short >= 1)
    return [Rule("COV-03", (*no, ("no_value", missing), ("all_units", k >= n)), share, F.concat(F.col("variable"), F.lit(": rests on "), k.cast("string"), F.lit(" units, "), _percent(share)))]


def distribution_rules() -> list[Rule]:
    """How percentiles are spread over the area."""
    n, s, tag = F.col("area_units"), F.col("representative_score"), F.col("coherence")
    base = (_not_in(CONTINUOUS), ("one_unit", n.eqNullSafe(1)), _bad_status(), ("suppressed", F.col("suppressed")), ("no_value", s.isNull()))
    big = F.coalesce(n >= COHERENT, F.lit(False))
    many = (*base, ("fewer_than_5", ~big))
    core, name = F.col("core_share"), F.col("variable")
    other = lambda *tags: (_because("coherence", "coherence"), ~F.coalesce(tag.isin(*tags), F.lit(False)))
    return [
        Rule("DIS-01", (*many, ("no_window", core.isNull() | F.col("window_lo").isNull())), core, F.concat(name, F.lit(": "), _percent(core), F.lit(" within one window"))),
        Rule("DIS-02", (*many, ("no_quantiles", F.col("p10").isNull() | F.col("p90").isNull())), F.col("p90") - F.col("p10"), F.concat(name, F.lit(": middle 80% from "), _nth("p10"), F.lit(" to "), _nth("p90"))),
        Rule("DIS-03", (*base, ("no_distribution_block", F.col("method") != "area_weighted"), ("no_min_max", F.col("least").isNull() | F.col("most").isNull())), F.col("most") - F.col("least"), F.concat(name, F.lit(": from "), _nth("least"), F.lit(" to "), _nth("most"))),
        Rule("DIS-04", (*many, other("split")), 1 - core, F.concat(name, F.lit(": half is tied at one value, "), _percent(1 - core), F.lit(" lies elsewhere"))),
        Rule("DIS-05", (*base, ("five_or_more", big)), n, F.concat(name, F.lit(": too few units for a spread label"))),
        Rule("DIS-06", (*many, other("concentrated", "spread")), core, F.concat(name, F.lit(": units are "), tag)),
    ]


def categorical_rules() -> list[Rule]:
    """Classes of a mixture. ``top_share`` and ``rest_share`` are the commonest class's share and that of those not listed."""
    status, one, classes = F.col("status"), F.col("area_units").eqNullSafe(1), F.col("n_classes")
    base = (_not_in(("class_mixture",)), (_because("status", "status"), ~F.coalesce(status.isin("ok", "low_coverage"), F.lit(False))), ("no_mixture", ~F.coalesce(classes > 0, F.lit(False))))
    several = (*base, ("one_unit", one), ("one_class", classes == 1))
    top, label = F.col("top_share"), F.col("modal_class")
    return [
        Rule("CAT-01", (*base, ("multi_unit", ~one)), top, label),
        Rule("CAT-02", (*base, ("one_unit", one)), top, F.concat(label, F.lit(" is commonest: "), _percent(top))),
        Rule("CAT-03", several, F.col("rest_share"), F.concat(F.lit("classes: "), classes.cast("string"))),
        Rule("CAT-04", (*several, (_because("coherence", "coherence"), ~F.coalesce(F.col("coherence").isin("concentrated", "mixed"), F.lit(False)))), top, F.concat(F.lit("the classes are "), F.col("coherence"))),
    ]


def pair_rules() -> list[Rule]:
    """A variable against its upstream version: columns of the local row, and those of the other with ``up_`` before them;
    ``paired`` tells whether there is one."""
    one, none = F.col("area_units").eqNullSafe(1), ("no_partner", ~F.col("paired"))

    def usable(p: str) -> Column:
        s = F.col(f"{p}representative_score")
        return F.coalesce(F.col(f"{p}status").eqNullSafe("ok") & ~F.coalesce(f"{p}suppressed", F.lit(False)) & (s != 0), F.lit(False))

    both = usable("") & usable("up_")
    gap = F.col("up_representative_score") - F.col("representative_score")
    shown = F.round("up_representative_score") - F.round("representative_score")
    side = F.when(shown > 0, "higher").when(shown < 0, "lower").otherwise("level")
    name = F.col("variable")
    return [
        Rule("LU-01", (none, ("side_not_usable", ~both), ("multi_unit", ~one)), F.abs(gap), F.concat(name, F.lit(": upstream is "), side)),
        Rule("LU-02", (none, ("side_not_usable", ~both), ("one_unit", one)), F.abs(gap), F.concat(name, F.lit(": upstream is on average "), side)),
        Rule("LU-03", (none, ("multi_unit", ~one), ("no_raw", F.col("representative_raw").isNull() | F.col("up_representative_raw").isNull())), None, F.concat(name, F.lit(": value here and upstream"))),
        Rule("LU-04", (none, ("both_usable", both)), None, F.concat(name, F.lit(": a side has no percentile"))),
        Rule("LU-05", (("has_partner", F.col("paired")),), None, F.concat(name, F.lit(": no separate upstream value"))),
    ]


def within_band(rows: DataFrame, keys: list[str], groups: dict[str, tuple[str, list[str], str]]) -> DataFrame:
    """Statements that join a few variables of one query: keys, rule, item, applies, reason, stat.

    ``groups``: item -> (rule, variables, kind). ``sum`` and ``span`` (last less first) and ``ratio`` (last by first) are of the
    variables' raw values; ``filled`` is a sum in which a variable outside its domain counts as zero; ``ranks`` is the span of
    usable percentiles; ``gap`` is the first less the second, which is part of it; ``class`` tells that the first, a class, is
    present while all others lie outside their domain. All but ``ranks`` and ``ratio`` need a query of one unit.
    """
    status_ok = F.col("status") == "ok"
    raw = F.when(status_ok, F.col("representative_raw"))
    filled = F.coalesce(raw, F.when(F.col("status") == "outside_active_domain", 0.0))
    rank = F.when(status_ok & ~F.coalesce("suppressed", F.lit(False)), F.col("representative_score"))
    names = sorted({v for _, vs, _ in groups.values() for v in vs})
    at = lambda v, x: F.max(F.when(F.col("variable") == v, x))
    wide = rows.groupBy(*keys).agg(F.max("area_units").alias("_n"), F.max("scope").alias("_scope"), *(at(v, x).alias(f"{p}{v}") for v in names for p, x in (("r_", raw), ("f_", filled), ("s_", rank), ("t_", F.col("status")))))

    def one(item: str) -> Column:
        rule, vs, kind = groups[item]
        if kind == "class":
            outside = F.lit(True)
            for v in vs[1:]:
                outside = outside & F.col(f"t_{v}").eqNullSafe("outside_active_domain")
            reason = F.when(~F.col("_n").eqNullSafe(1), "multi_unit").when(~F.col(f"t_{vs[0]}").eqNullSafe("ok"), "class_absent").when(~outside, "extent_positive_or_empty")
            return F.struct(F.lit(rule).alias("rule"), F.lit(item).alias("item"), reason.isNull().alias("applies"), reason.alias("reason"), F.lit(None).cast("double").alias("stat"))
        cols = [F.col(f"{ {'filled': 'f_', 'ranks': 's_'}.get(kind, 'r_') }{v}") for v in vs]
        missing = F.lit(False)
        for c in cols:
            missing = missing | c.isNull()
        total = cols[0]
        for c in cols[1:]:
            total = total + c
        stat = {"sum": total, "filled": total, "span": cols[-1] - cols[0], "gap": cols[0] - cols[-1], "ratio": F.try_divide(cols[-1], F.when(cols[0] > 0, cols[0])), "ranks": (F.greatest(*cols) - F.least(*cols)) if len(cols) > 1 else F.lit(0.0)}[kind]
        why = {"sum": "side_not_usable", "ranks": "side_not_usable", "filled": "extent_empty", "span": "row_empty", "gap": "extent_zero_or_empty", "ratio": "row_empty"}[kind]
        reason = F.when(missing, why)
        if kind == "ratio":
            reason = F.when(F.col("_scope") == "polity", "not_areal").otherwise(reason)
        elif kind != "ranks":
            reason = F.when(~F.col("_n").eqNullSafe(1), "multi_unit").otherwise(reason)
        return F.struct(F.lit(rule).alias("rule"), F.lit(item).alias("item"), reason.isNull().alias("applies"), reason.alias("reason"), F.when(reason.isNull(), stat.cast("double")).alias("stat"))

    return wide.select(*keys, F.inline(F.array(*map(one, groups))))


def cross_band(rows: DataFrame, keys: list[str], bands: str = "ABCDE") -> DataFrame:
    """What stands out within a band and over all bands: keys, rule, item, applies, reason, stat, named.

    Eligible rows have a usable percentile and, but for the dominant unit's, a known zero share below ZERO_AWARE. Of a
    variable and its upstream version (equal ``pair``) the one farther from 50 is named.
    """
    s = F.col("representative_score")
    global_ = (F.col("method") == "dominant_unit") | (F.col("zero_fraction") < ZERO_AWARE)
    fit = rows.where(F.col("method").isin(*SINGLE) & (F.col("status") == "ok") & ~F.coalesce("suppressed", F.lit(False)) & s.isNotNull() & F.coalesce(global_, F.lit(False)))
    far = fit.select(*keys, "band", "pair", F.struct((-F.abs(s - 50)).alias("k"), "variable").alias("f"), s.alias("s"))
    named = lambda x, n: F.transform(F.slice(F.array_sort(x), 1, n), lambda v: v["variable"])

    def told(by: list[str], n: int) -> DataFrame:
        best = far.groupBy(*by, "pair").agg(F.min("f").alias("f")).groupBy(*by).agg(F.collect_list("f").alias("_top"))
        counts = far.groupBy(*by).agg(
            F.count("*").alias("_m"), F.count_if((F.col("s") <= TAIL) | (F.col("s") >= 100 - TAIL)).alias("_k"), F.median(F.abs(F.col("s") - 50)).alias("_d"))
        return best.join(counts, by).withColumn("_named", named(F.col("_top"), n)).withColumn("_first", -F.array_min("_top")["k"])

    each = rows.select(*keys).distinct().withColumn("band", F.explode(F.array(*map(F.lit, bands)))).join(told([*keys, "band"], 2), [*keys, "band"], "left")
    enough = F.coalesce(F.col("_m") >= BAND_LEAST, F.lit(False))
    fields = lambda ok, why, stat, names_: (ok.alias("applies"), F.when(~ok, why).alias("reason"), F.when(ok, stat).cast("double").alias("stat"), F.when(ok, names_).alias("named"))
    first = each.select(*keys, F.lit("XB-01").alias("rule"), F.concat(F.lit("band "), "band").alias("item"), *fields(enough, "fewer_than_3", F.col("_first"), F.col("_named")))
    whole = rows.select(*keys).distinct().join(told(keys, 3), keys, "left")
    enough = F.coalesce(F.col("_m") >= ALL_LEAST, F.lit(False))
    none = F.lit(None).cast("array<string>")
    parts = (("XB-02", F.col("_first"), F.col("_named")), ("XB-03", F.col("_k") / F.col("_m"), none), ("XB-04", F.col("_d"), none))
    rest = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit("(all bands)").alias("item"), *fields(enough, "fewer_than_5", stat, names_)) for r, stat, names_ in parts))
    return first.unionByName(whole.select(*keys, F.inline(rest)))


#: First and last year of the yearly record and of the event catalogue.
YEARLY, EVENTS = (0, 1998), (-491, 1890)


#: Epochs whose figures carry a caveat of their source.
CAVEAT_EPOCHS = (1950,)


def over_time(spans: DataFrame, yearly: DataFrame, epochs: DataFrame, events: DataFrame, fields: list[str], uses: list[str]) -> DataFrame:
    """Statements about a span (query_id, low, high): query_id, rule, item, applies, reason, stat.

    ``yearly`` is (query_id, variable, year, value, n_cells, least, most) of the variables ``fields``, with the number of grid
    cells of a value and the range of theirs; ``epochs`` is (query_id, variable, year, value) of ``uses``: those inside the
    span, or the nearest one; ``events`` is (query_id, year, size).

    BT-01 mean of the yearly values; BT-02 range of the cells in the middle year; BT-03 number of cells; BT-04 the part of the span
    that is covered; BT-05 total of a single epoch; BT-06 change from the first to the last epoch; BT-07 years from the span to
    the nearest epoch; BT-08 an epoch with a caveat; BT-09 the largest event; BT-10 no events.
    """
    none = F.lit(None).cast("double")
    row = lambda rule, item, reason, stat: F.struct(F.lit(rule).alias("rule"), item.alias("item"), reason.isNull().alias("applies"), reason.alias("reason"), F.when(reason.isNull(), stat).cast("double").alias("stat"))
    asked = lambda names: spans.select("query_id", F.explode(F.array(*map(F.lit, names))).alias("variable"))
    whole = F.lit("(query)")

    numbered = yearly.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "variable").orderBy("year")))
    of_field = numbered.groupBy("query_id", "variable").agg(F.avg("value").alias("m"), F.sort_array(F.collect_list(F.struct("_k", "n_cells", "least", "most"))).alias("_all"))
    # a span has no more years than the record
    of_field = of_field.withColumn("_mid", F.element_at("_all", (F.floor(F.size("_all") / 2) + 1).cast("int")))
    means = asked(fields).join(of_field, ["query_id", "variable"], "left")
    absent = F.when(F.col("m").isNull(), "no_yearly_rows")
    first = means.select("query_id", F.inline(F.array(
        row("BT-01", F.col("variable"), absent, F.col("m")),
        row("BT-02", F.col("variable"), absent.when(F.coalesce("_mid.n_cells", F.lit(0)) < 2, "one_cell"), F.col("_mid.most") - F.col("_mid.least")),
    )))

    place = F.struct(*(F.when(F.col("variable") == v, k).alias(f"_{k}") for k, v in enumerate(fields)))
    at = F.coalesce(*(place[f"_{k}"] for k in range(len(fields))), F.lit(len(fields)))
    of_query = yearly.groupBy("query_id").agg(F.count_distinct("year").alias("n"), F.min("year").alias("a"), F.max("year").alias("b"), F.min_by("n_cells", F.struct(at, F.col("year"))).alias("cells"))
    covered = spans.join(of_query, "query_id", "left")
    outside = (F.col("high") < YEARLY[0]) | (F.col("low") > YEARLY[1])
    partly = (F.col("a") > F.col("low")) | (F.col("b") < F.col("high"))
    why = F.when(F.col("n").isNull(), F.when(~outside, "no_rows_inside_record")).otherwise(F.when(~partly, "fully_covered"))
    second = covered.select("query_id", F.inline(F.array(
        row("BT-03", whole, F.when(F.col("n").isNull(), "no_yearly_rows"), F.col("cells")),
        row("BT-04", whole, why, F.coalesce(F.col("n") / (F.col("high") - F.col("low") + 1), F.lit(0.0))),
    )))

    ends = epochs.groupBy("query_id", "variable").agg(F.count("*").alias("n"), F.min_by("value", "year").alias("a"), F.max_by("value", "year").alias("b"))
    any_ = epochs.groupBy("query_id").agg(F.count_distinct("year").alias("_n"), F.min("year").alias("_a"), F.sum("value").alias("_sum"), F.max(F.col("year").isin(*CAVEAT_EPOCHS)).alias("_caveat"))
    change = asked(uses).join(ends, ["query_id", "variable"], "left").join(any_, "query_id", "left")
    why = F.when(F.col("_n").isNull(), "no_epoch_rows").when(F.coalesce("n", F.lit(0)) < 2, "single_epoch")
    third = change.select("query_id", F.inline(F.array(row("BT-06", F.col("variable"), why, F.when(F.col("a") > 0, (F.col("b") - F.col("a")) / F.col("a")).otherwise(none)))))
    shown = spans.join(any_, "query_id", "left")
    absent = F.when(F.col("_n").isNull(), "no_epoch_rows")
    away = F.when(F.col("_a") < F.col("low"), F.col("low") - F.col("_a")).when(F.col("_a") > F.col("high"), F.col("_a") - F.col("high"))
    single = shown.select("query_id", F.inline(F.array(
        row("BT-05", whole, absent.when(F.col("_n") > 1, "several_epochs"), F.col("_sum")),
        row("BT-07", whole, absent.when(away.isNull(), "epoch_inside_span"), away),
        row("BT-08", whole, absent.when(~F.col("_caveat"), "no_caveat"), none),
    )))

    largest = spans.select("query_id").join(events.groupBy("query_id").agg(F.max("size").alias("top")), "query_id", "left")
    top = F.col("top")
    fourth = largest.select("query_id", F.inline(F.array(row("BT-09", whole, F.when(top.isNull(), "no_events"), top), row("BT-10", whole, F.when(top.isNotNull(), "events_present"), F.lit(0.0)))))
    return first.unionByName(second).unionByName(third).unionByName(single).unionByName(fourth)


#: Upper ends of the classes of seasonal concentration; kilometres within which an outline counts as the coast.
SEASON_CUTS, SEASONS, COAST_KM = [0.15, 0.35, 0.60], ["even", "moderate", "clear", "strong"], 2.0


def season_class(concentration: Column) -> Column:
    return binned(concentration, SEASON_CUTS, SEASONS)


def wettest_month(curve: Column) -> Column:
    """From 1, the first of equal months; null unless the curve has twelve values."""
    whole = (F.size(curve) == 12) & ~F.exists(curve, lambda v: v.isNull())
    return F.when(whole, F.array_position(curve, F.array_max(curve)).cast("int"))


def profile_units(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Short profile statements: keys, rule, applies, reason, named.

    ``rows`` has concentration, curve (twelve months), lake and wetland (hundredths of the area), others (names of further regions,
    largest first, null where the unit has no region) and edge_km (from the nearest edge to the coast).
    """
    row = lambda rule, reason, named: F.struct(F.lit(rule).alias("rule"), reason.isNull().alias("applies"), reason.alias("reason"), F.when(reason.isNull(), named).alias("named"))
    month = wettest_month(F.col("curve"))
    season = row("S2.1b", F.when(F.col("concentration").isNull() | month.isNull(), "no_monthly_values"), F.concat(season_class(F.col("concentration")), F.when(season_class(F.col("concentration")) == "even", F.lit("")).otherwise(F.concat(F.lit(", month "), month.cast("string")))))
    wet = {"lakes": F.coalesce(F.col("lake") > 0, F.lit(False)), "wetlands": F.coalesce(F.col("wetland") > 0, F.lit(False))}
    both_null = F.col("lake").isNull() & F.col("wetland").isNull()
    water = row("S3.4", F.when(both_null, "no_value").when(~wet["lakes"] & ~wet["wetlands"], "none_recorded"), F.concat_ws(", ", *(F.when(c, n) for n, c in wet.items())))
    regions = row("S1.4", F.when(F.col("others").isNull(), "no_region").when(F.size("others") == 0, "no_other_region"), F.array_join("others", ", "))
    coast = row("S7.3", F.when(~F.coalesce(F.col("edge_km") <= COAST_KM, F.lit(False)), "not_the_coast"), F.lit("nearest edge is the coast"))
    return rows.select(*keys, F.inline(F.array(season, water, regions, coast)))


def leaders(rows: DataFrame, keys: list[str], score: str = "representative_score", n: int = 3, floor: float = 25.0) -> DataFrame:
    """What makes a query distinct: its n variables farthest from 50, at least ``floor`` points: keys, variable, far, rank."""
    far = F.abs(F.col(score) - 50)
    w = Window.partitionBy(*keys).orderBy(F.desc("far"), "variable")
    return rows.where(far >= floor).select(*keys, "variable", far.alias("far")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def water_provenance(endo: Column, coast: Column, dist: Column, rain_ratio: Column, dry_ratio: Column, warm_ratio: Column, upstream_area: Column) -> Column:
    """Where a unit's water comes from; the first rule that holds. Ratios are upstream over local values; an unknown one counts
    as near 1."""
    small = F.coalesce(upstream_area < 500, F.lit(False))
    more = F.coalesce(rain_ratio > 1.5, F.lit(False)) | F.coalesce(dry_ratio > 1.5, F.lit(False))
    near = F.lit(True)
    for ratio in (rain_ratio, dry_ratio, warm_ratio):
        near = near & F.coalesce(ratio.between(0.9, 1.1), F.lit(True))
    return (
        F.when(endo >= 1, "endorheic")
        .when((coast == 1) & (dist < 10), "coastal")
        .when(~small & more, "exogenous")
        .when(small, "undetermined")
        .when(near, "uniform")
        .otherwise("local")
    )


def texture_classes(sand: Column, silt: Column, clay: Column) -> Column:
    """All soil texture classes of the published triangle whose definition hundredths of sand, silt and clay meet; one of whole
    shares."""
    light, heavy = silt + 1.5 * clay, silt + 2 * clay
    rules = (
        ("sand", (sand > 85) & (light < 15)),
        ("loamy sand", sand.between(70, 90) & (light >= 15) & (heavy < 30)),
        ("sandy loam", ((clay >= 7) & (clay < 20) & (sand > 52) & (heavy >= 30)) | ((clay < 7) & (silt < 50) & (heavy >= 30))),
        ("loam", (clay >= 7) & (clay < 27) & (silt >= 28) & (silt < 50) & (sand <= 52)),
        ("silt loam", ((silt >= 50) & (clay >= 12) & (clay < 27)) | ((silt >= 50) & (silt < 80) & (clay < 12))),
        ("silt", (silt >= 80) & (clay < 12)),
        ("sandy clay loam", (clay >= 20) & (clay < 35) & (silt < 28) & (sand > 45)),
        ("clay loam", (clay >= 27) & (clay < 40) & (sand > 20) & (sand <= 45)),
        ("silty clay loam", (clay >= 27) & (clay < 40) & (sand <= 20)),
        ("sandy clay", (clay >= 35) & (sand > 45)),
        ("silty clay", (clay >= 40) & (silt >= 40)),
        ("clay", (clay >= 40) & (sand <= 45) & (silt < 40)),
    )
    return F.filter(F.array(*(F.when(c, name) for name, c in rules)), lambda x: x.isNotNull())


def texture(sand: Column, silt: Column, clay: Column) -> Column:
    """struct(name, unsure): the texture class, null unless just one fits, and whether half a point more or less of any share,
    which is what rounding leaves open, gives another."""
    own = texture_classes(sand, silt, clay)
    half = (-0.5, 0.0, 0.5)
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in half for b in half for c in half))
    near = F.array_distinct(F.transform(around, lambda o: texture_classes(sand + o["a"], silt + o["b"], clay + o["c"])))
    one = F.size(own) == 1
    known = sand.isNotNull() & silt.isNotNull() & clay.isNotNull()
    return F.struct(F.when(one, own[0]).alias("name"), F.when(known, ~one | (F.size(near) > 1)).alias("unsure"))


def whole_shares(sand: Column, silt: Column, clay: Column) -> Column:
    """struct(sand, silt, clay): whole hundredths that add up to 100; what rounding leaves goes to the largest share, the first of
    equal ones."""
    total = sand + silt + clay
    raw = [100 * c / total for c in (sand, silt, clay)]
    out = [F.bround(c) for c in raw]
    rest = 100 - (out[0] + out[1] + out[2])
    largest = F.when((raw[0] >= raw[1]) & (raw[0] >= raw[2]), 0).when(raw[1] >= raw[2], 1).otherwise(2)
    return F.struct(*((c + F.when(largest == k, rest).otherwise(0.0)).alias(n) for k, (n, c) in enumerate(zip(("sand", "silt", "clay"), out, strict=True))))


#: Upper ends of slope classes in hundredths, their names, and half a step of the stored degrees.
SLOPE_EDGES = [1.0, 2.0, 5.0, 10.0, 15.0, 30.0, 60.0]
SLOPES = ["level", "very gently sloping", "gently sloping", "sloping", "strongly sloping", "moderately steep", "steep", "very steep"]
DEGREE_STEP = 0.05


def slope(degrees: Column) -> Column:
    """struct(name, percent, unsure): the slope class, and whether the stored step could put it in a neighbouring one."""
    percent = lambda d: F.tan(F.radians(d)) * 100
    name = lambda d: binned(percent(d), SLOPE_EDGES, SLOPES)
    return F.struct(name(degrees).alias("name"), percent(degrees).alias("percent"), (name(F.greatest(degrees - DEGREE_STEP, F.lit(0.0))) != name(degrees + DEGREE_STEP)).alias("unsure"))


def aridity(hundredths: Column) -> Column:
    """struct(name, index, unsure) of a stored whole index times 100."""
    name = lambda x: binned(x / 100, UNEP_EDGES, UNEP_LABELS)
    return F.struct(name(hundredths).alias("name"), (hundredths / 100).alias("index"), (name(hundredths - 0.5) != name(hundredths + 0.5)).alias("unsure"))
