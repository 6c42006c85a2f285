"""The bounded sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most. More labels are thinned by a hash of the id.
SAMPLE_ROWS = 8_000


def sample(labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, y) of at most about ``rows`` labelled ids for which ``learn`` holds; both classes keep their shares.

    An id with several labels takes the largest; null ids and labels are left out. The result is bounded by ``rows`` and
    may be broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(rows * 1_000_000 // n))
    return known
