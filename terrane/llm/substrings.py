"""Substring deduplication by hashing of lines or paragraphs.

Units are normalised and hashed to 128 bits; digests are grouped over all documents by a pre-aggregated minimum, so a unit
that is everywhere is one row per task before the shuffle; the earliest ranked occurrence stays and every other one is
cut out, with its offsets in the original text retained.

A passage that repeats inside longer units, with other text beside it, is no unit and stays; ``passages`` finds those.

Defined cases: a null or empty text has no units; lines without words are no units, and with
``min_words`` neither are those of fewer words; equal ranks are ordered by doc_id, then by a hash of the text, then by place; rows of a null id are left alone;
rows that repeat an id and a text keep or lose the same units, rows that repeat an id with another text are told apart;
other columns are passed on by ``clean``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from terrane.llm.common import materialize, small_batches

SEPARATOR = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[\x20\x09-\x0D]*\n")}
MIN_WORDS = 1


def units(text: str, kind: str = "line", min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit, in characters. Normal form: A-Z lower-cased, words with single spaces."""
    at = 0
    for stop in [*(m.span() for m in SEPARATOR[kind].finditer(text)), (len(text), len(text))]:
        words = text[at : stop[0]].encode().lower().split()
        if len(words) >= min_words:
            yield at, stop[0], xxhash.xxh3_128_digest(b" ".join(words))
        at = stop[1]


def _key(text: Column) -> Column:
    """Tells apart rows of one id by their texts."""
    return F.xxhash64(text)


def occurrences(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, rank: str | None = None) -> DataFrame:
    """(rank, doc_id, key, start, end, d1, d2) of every unit of the rows of (doc_id, text)."""
    names = ["rank", "doc_id", "key"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            row, starts, ends, digests = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for a, b, d in units(text, kind, min_words):
                    row.append(i)
                    starts.append(a)
                    ends.append(b)
                    digests.append(d)
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            own = batch.select(names).take(pa.array(row, pa.int32()))
            yield pa.record_batch([*own.columns, pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1])], names=[*names, "start", "end", "d1", "d2"])

    by = F.col(rank).cast("long") if rank else F.lit(0).cast("long")
    src = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(by.alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("text")).alias("key"), "text")
    return src.mapInArrow(run, "rank long, doc_id long, key long, start long, end long, d1 long, d2 long")


def repeats(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, rank: str | None = None) -> DataFrame:
    """Units to remove: doc_id, key (of the row's text), start, end (characters of the original text), kept_doc_id,
    kept_start, copies."""
    small_batches(docs.sparkSession)
    # cut and hashed twice rather than stored: texts are read faster than units are written
    found = occurrences(docs, kind, min_words, rank)
    place = F.struct(F.coalesce("rank", F.lit(2**63 - 1)).alias("rank"), "doc_id", "key", "start")
    groups = found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = materialize(groups, "substrings-groups")
    out = found.join(groups, ["d1", "d2"]).where("NOT (doc_id = first.doc_id AND key = first.key AND start = first.start)")
    return out.select("doc_id", "key", "start", "end", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"), "copies")


def clean(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, rank: str | None = None, removed: str = "removed") -> DataFrame:
    """The documents without repeated units, a unit's separator going with it, and the column ``removed``: start and end of
    each removed unit in the original text, and where its kept occurrence stands. Other columns stay as they are."""
    span = F.struct("start", "end", "kept_doc_id", "kept_start")
    spans = repeats(docs, kind, min_words, rank).groupBy(F.col("doc_id").alias("__doc"), F.col("key").alias("__key")).agg(F.array_sort(F.collect_set(span)).alias("__cut"))
    names = docs.columns
    parts = SEPARATOR[kind]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = []
            for text, cut in zip(batch.column("text").to_pylist(), batch.column("__cut").to_pylist(), strict=True):
                if cut and text is not None:
                    kept, at = [], 0
                    for c in cut:
                        kept.append(text[at : c["start"]])
                        sep = parts.match(text, c["end"])
                        at = sep.end() if sep else c["end"]
                    text = "".join([*kept, text[at:]])
                texts.append(text)
            yield pa.record_batch([*(pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names), batch.column("__cut")], names=[*names, removed])

    at = (docs["doc_id"] == F.col("__doc")) & (_key(docs["text"]) == F.col("__key"))
    joined = docs.join(spans, at, "left").drop("__doc", "__key").withColumn("__cut", F.coalesce("__cut", F.array().cast(spans.schema["__cut"].dataType)))
    return joined.mapInArrow(run, StructType([*docs.schema.fields, StructField(removed, joined.schema["__cut"].dataType)]))


def remove(docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, rank: str | None = None) -> DataFrame:
    """The documents without repeated units; columns stay as they are."""
    return clean(docs, kind, min_words, rank, "__removed").drop("__removed")


CLEAN_SQL = r"""
WITH k AS (SELECT doc_id, text, row_number() OVER () AS rk, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT rk, doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM k WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT rk, doc_id, i, s, (sum(length(s) + 1) OVER (PARTITION BY rk ORDER BY i) - length(s) - 1)::BIGINT AS start FROM l),
u AS (SELECT *, (start + length(s))::BIGINT AS stop,
             trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+', ' ', 'g'), ' ') AS n FROM p),
g AS (SELECT *, n <> '' AND row_number() OVER (PARTITION BY n ORDER BY doc_id, start) > 1 AS gone FROM u),
-- a removed unit takes the line break after it along
c AS (SELECT rk, coalesce(string_agg(CASE WHEN gone THEN '' WHEN i = m THEN s ELSE s || chr(10) END, '' ORDER BY i), '') AS text,
             count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(start || '-' || stop, ',' ORDER BY start) FILTER (WHERE gone), '') AS removed
      FROM (SELECT *, max(i) OVER (PARTITION BY rk) AS m FROM g) GROUP BY rk)
SELECT k.doc_id, CASE WHEN c.rk IS NULL THEN k.text ELSE c.text END AS text, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed FROM k LEFT JOIN c USING (rk)
"""
