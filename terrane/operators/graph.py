"""Trees and neighbourhoods given as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import stored


def ancestors(links: DataFrame, node: str, parent: str, length: str | None = None, stop: str | None = None) -> DataFrame:
    """(node, ancestor, depth) for every node below a root, by doubling: after k rounds all paths of up to 2**k steps are known,
    so a chain of d steps takes log2(d) joins. A round joins only the paths of full length, whose table is written, and makes
    only new pairs; rounds end when there are none. Each node has one parent; parents that are null or 0 end a path. A cycle is
    an error.

    With ``length``, a column for the step from a node to its parent, ``distance`` is added: the sum of the steps; a step without
    a length has none, nor has any path over it. With ``stop``, a boolean column, a node for which it is true has no part in any
    path: nothing drains through it, to it or from it.
    """
    some = links.where(~F.coalesce(F.col(stop), F.lit(False))) if stop else links
    some = some.where(F.col(parent).isNotNull() & (F.col(parent) != 0))
    first = some.select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth"), *([F.col(length).cast("double").alias("distance")] if length else []))
    if stop:
        first = first.join(links.where(F.col(stop)).select(F.col(node).alias("ancestor")), "ancestor", "left_anti").select(*first.columns)
    known, longest, reach = stored(first), None, 1
    if not known.where("node = ancestor").isEmpty():
        raise ValueError("the links have a cycle")
    further = [(F.col("distance") + F.col("_far")).alias("distance")] if length else []
    while True:
        longest = known.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("_via"), *([F.col("distance").alias("_far")] if length else []))
        more = longest.join(known.withColumnRenamed("node", "_via"), "_via").select("node", "ancestor", (F.col("depth") + reach).alias("depth"), *further)
        more = stored(more)
        rows, loops = more.agg(F.count("*"), F.count_if(F.col("node") == F.col("ancestor"))).first()
        if loops:
            raise ValueError("the links have a cycle")
        if not rows:
            return known
        known = known.unionByName(more)
        reach *= 2


def catchments(links: DataFrame, targets: DataFrame, node: str, parent: str, length: str, stop: str) -> DataFrame:
    """target, node, depth, distance: each target and all nodes that drain to it without passing one where ``stop`` is true; a
    target that is such a node itself has none. ``targets`` is (target). Distances and depths count from the target."""
    at = targets.join(links.where(~F.coalesce(F.col(stop), F.lit(False))).select(F.col(node).alias("target")), "target", "left_semi")
    up = ancestors(links, node, parent, length, stop).withColumnRenamed("ancestor", "target").join(at, "target", "left_semi")
    own = at.select("target", F.col("target").alias("node"), F.lit(0).alias("depth"), F.lit(0.0).alias("distance"))
    return own.unionByName(up.select("target", "node", "depth", "distance"))


def subtree_totals(closure: DataFrame, units: DataFrame, unit: str, value: str) -> DataFrame:
    """unit, n_upstream, total: the unit's own value and those of all units that drain to it."""
    up = closure.join(units.select(F.col(unit).alias("node"), F.col(value).alias("_v")), "node").groupBy(F.col("ancestor").alias(unit)).agg(F.count("*").alias("n_upstream"), F.sum("_v").alias("_up"))
    return units.join(up, unit, "left").select(unit, F.coalesce("n_upstream", F.lit(0)).alias("n_upstream"), (F.col(value) + F.coalesce("_up", F.lit(0))).alias("total"))


def flow_class(pairs: DataFrame, closure: DataFrame, centre: str, neighbour: str, root: str, neighbour_root: str) -> DataFrame:
    """Adds ``flow`` to neighbour pairs: up1 or upN if the neighbour drains to the centre in one or more steps, dn1 or dnN if
    the centre drains to it, same for another branch of one tree, other for another tree."""
    up = closure.select(F.col("node").alias(neighbour), F.col("ancestor").alias(centre), F.col("depth").alias("_up"))
    down = closure.select(F.col("node").alias(centre), F.col("ancestor").alias(neighbour), F.col("depth").alias("_dn"))
    both = pairs.join(up, [centre, neighbour], "left").join(down, [centre, neighbour], "left")
    flow = (
        F.when(F.col("_up") == 1, "up1").when(F.col("_up") > 1, "upN").when(F.col("_dn") == 1, "dn1").when(F.col("_dn") > 1, "dnN")
        .when(F.col(root) == F.col(neighbour_root), "same").otherwise("other")
    )
    return both.select(*pairs.columns, flow.alias("flow"))


#: Fewest neighbours with a value for a comparison, and for "all but one"; a step that counts as sharp.
RING_LEAST, RING_ALL_BUT_ONE, SHARP = 3, 5, 10.0


def ring_comparison(pairs: DataFrame, centre: str, own: str, theirs: str, least: int = RING_LEAST) -> DataFrame:
    """centre, n, n_less, n_more, side, k, top, bottom, all_but_one: how the centre stands among its neighbours.

    ``side`` is more (than the ``n_less`` of them) or less, ``k`` the neighbours on that side. Values are compared to six places.
    Centres without a value, with fewer than ``least`` neighbours that have one, or equal to all of them, have no row.
    """
    c, x = F.round(own, 6), F.round(theirs, 6)
    counts = pairs.where(c.isNotNull() & x.isNotNull()).groupBy(centre).agg(F.count("*").alias("n"), F.count_if(x < c).alias("n_less"), F.count_if(x > c).alias("n_more"))
    counts = counts.where((F.col("n") >= least) & ((F.col("n_less") > 0) | (F.col("n_more") > 0)))
    n, less, more = F.col("n"), F.col("n_less"), F.col("n_more")
    k = F.greatest(less, more)
    return counts.select(
        centre, "n", "n_less", "n_more", F.when(less >= more, "more").otherwise("less").alias("side"), k.alias("k"), (less == n).alias("top"), (more == n).alias("bottom"),
        ((n >= RING_ALL_BUT_ONE) & (k == n - 1)).alias("all_but_one"),
    )


def transitions(pairs: DataFrame, centre: str, variable: str, own: str, theirs: str, sharp: float = SHARP) -> DataFrame:
    """centre, variable, max_abs, mean_abs, n_sharp, sign_pattern over the steps (own less neighbour's score, to one place):
    largest and mean size, how many are sharp, and whether all are above 0 (all+), below (all-) or mixed."""
    steps = pairs.where(F.col(own).isNotNull() & F.col(theirs).isNotNull()).select(centre, variable, F.round(F.col(own) - F.col(theirs), 1).alias("_d"))
    d = F.col("_d")
    return steps.groupBy(centre, variable).agg(
        F.round(F.max(F.abs(d)), 1).alias("max_abs"), F.round(F.avg(F.abs(d)), 1).alias("mean_abs"), F.count_if(F.abs(d) >= sharp).alias("n_sharp"),
        F.when(F.min(d) > 0, "all+").when(F.max(d) < 0, "all-").otherwise("mixed").alias("sign_pattern"),
    )


def grid_neighbours(cells: DataFrame, row: str, col: str, width: int) -> DataFrame:
    """(row, col, n_row, n_col): the eight neighbours of each cell that are cells too; columns wrap around. An equi-join on
    generated neighbour keys."""
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    around = cells.select(row, col, F.inline(offsets)).select(row, col, (F.col(row) + F.col("i")).alias("n_row"), F.pmod(F.col(col) + F.col("j"), F.lit(width)).alias("n_col"))
    return around.join(cells.select(F.col(row).alias("n_row"), F.col(col).alias("n_col")), ["n_row", "n_col"], "left_semi").select(row, col, "n_row", "n_col")

