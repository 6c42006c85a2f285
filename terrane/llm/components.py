"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum, pre-aggregated before its shuffle, and a join whose two sides are plain tables, so that
adaptive execution can split a hub's edges over tasks. Tables between steps are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import drop_table, materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return int(r[0]), int(r[1] or 0)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components", rows: int | None = None) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node reachable.

    Nulls, loops and repeated edges are ignored. An empty edge table gives an empty result. The number of rounds grows
    with the logarithm of the longest path, not with the number of nodes. ``rows`` is a bound of the edges, if one is known.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = materialize(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), f"{name}-edges", rows)
    state = _state(now)
    while state[0]:
        # large star: every larger neighbour is tied to the smallest node around
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low", 2 * state[0])
        large = materialize(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"{name}-large", state[0])
        # small star: a node's smaller neighbours and the node itself are tied to the smallest of them
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least", state[0])
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-edges", 2 * state[0])
        for t in (now, low, large, least):
            drop_table(t)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return materialize(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), name, 2 * state[0])
