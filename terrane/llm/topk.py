"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors become integers. Documents in id order are cut into ranges (segments) and queries into groups, both of bounded
size; each pair of a segment and a query group is one task-sized tile, to which both sides are dealt by the pair's
number. Within a tile the segment is cut into blocks of consecutive ids. For every query the blocks are ordered by the
sum over components of the largest possible product (the block's maximum where the query is positive, its minimum where
it is negative), and scored through the block's vectors until the bounds fall below the query's k-th score so far. The
tiles' lists, at most k rows for each query, are merged by a top-k window.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of different
lengths score the components that both have; rows of a null id take no part; rows that share an id are candidates once
each, and a query excludes all rows of its own id; a query id with several rows gives one list from its vectors' best; an empty
table or one without queries gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import materialize

SCALE = 64
#: Documents of a segment and queries of a group, about; documents of a block.
SEGMENT, GROUP, BLOCK = 16_384, 2_048, 256


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) with floor(SCALE * x) of each component."""
    v = F.col(vector_col)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = vectors.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False)))
    return src.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(SCALE * x.cast("double")).cast("long")).alias("v"))


def _matrix(lists: pd.Series, width: int) -> np.ndarray:
    if len(lists) and all(len(x) == width for x in lists):
        return np.stack(lists.to_numpy()).astype(np.float64)
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : min(width, len(x))] = x[:width]
    return out


def top_of_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, docs: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best documents, ties to the smaller id; documents in id order.

    Products of integers are exact in doubles up to 2**53; larger ones are computed in whole numbers.
    """
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(docs).max(initial=0)) * max(1, q.shape[1])
    if reach >= 2**53:
        q, docs = q.astype(object), docs.astype(object)
    elif reach < 2**24:
        q, docs = q.astype(np.float32), docs.astype(np.float32)
    starts = np.arange(0, len(ids), block)
    high, low = (f.reduceat(docs, starts) for f in (np.maximum, np.minimum)) if len(ids) else (docs, docs)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    # a heap for each query, as sorted rows: score falling, id rising
    none = -np.iinfo(np.int64).max
    best, owner = np.full((len(q), k), none, np.int64), np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    going = np.arange(len(q))
    for turn in range(len(starts)):
        at = order[going, turn]
        # an equal bound may still bring a smaller id, so only bounds below the k-th score end a query
        going, at = (x[bound[going, at].astype(np.float64) >= best[going, -1]] for x in (going, at))
        if not len(going):
            break
        for b in np.unique(at):
            rows, span = going[at == b], slice(starts[b], starts[b] + block)
            found = (q[rows] @ docs[span].T).astype(np.int64)
            found[q_ids[rows][:, None] == ids[span][None, :]] = none
            scores = np.concatenate((best[rows], found), 1)
            names = np.concatenate((owner[rows], np.broadcast_to(ids[span], found.shape)), 1)
            names[scores == none] = np.iinfo(np.int64).max
            keep = np.lexsort((names, -scores))[:, :k]
            best[rows], owner[rows] = np.take_along_axis(scores, keep, 1), np.take_along_axis(names, keep, 1)
    i, j = np.nonzero(best > none)
    return q_ids[i], owner[i, j], best[i, j]


def _tile(k: int):
    def run(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(docs):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
        docs = docs.sort_values("vec_id", kind="stable")
        width = max(queries["v"].map(len).max(), docs["v"].map(len).max())
        got = top_of_tile(queries["vec_id"].to_numpy(), _matrix(queries["v"], width), docs["vec_id"].to_numpy(), _matrix(docs["v"], width), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))

    return run


def _numbered(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """The rows with the number ``part`` of their range of ids; ranges hold about ``size`` rows."""
    n = df.count()
    parts = max(1, -(-n // size))
    ranged = df.repartitionByRange(parts, "vec_id", "spread") if parts > 1 else df
    numbered = materialize(ranged.withColumn("part", F.spark_partition_id() if parts > 1 else F.lit(0)).drop("spread"), name)
    return numbered, (numbered.agg(F.max("part")).first()[0] or 0) + 1


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k best: query_id, rank, vec_id, score. Queries are the rows whose id is divisible by ``every``."""
    spread = F.xxhash64("vec_id", "v")  # a repeated id may hold many rows; they spread over ranges
    whole = materialize(integer_vectors(vectors, id_col, vector_col).withColumn("spread", spread), "topk-vectors")
    docs, segments = _numbered(whole, SEGMENT, "topk-documents")
    asked = whole.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    queries, groups = _numbered(asked, GROUP, "topk-queries")
    segment = F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))
    group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = queries.withColumn("segment", segment).select("vec_id", "v", (F.col("part") * segments + F.col("segment")).alias("tile"))
    right = docs.withColumn("group", group).select("vec_id", "v", (F.col("group") * segments + F.col("part")).alias("tile"))
    near = left.groupBy("tile").cogroup(right.groupBy("tile")).applyInPandas(_tile(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SEARCH_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
