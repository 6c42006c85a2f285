"""Repeated passages of any place in a text, wherever lines begin and end.

Every window of ``width`` words is compared with every other one. To keep most windows out of the shuffle, each is first
known by the least hash of the shorter word runs in it (winnowing): equal windows have equal least hashes, so only windows
whose least hash stands in two places can repeat. Those are hashed to 128 bits and brought together over all documents; the
earliest ranked occurrence stays, and the other ones are merged into spans with offsets in the original text. No repeated
run of ``width`` words or more is lost.

Defined cases: a null or empty text and a text of fewer than ``width`` words have no windows; equal ranks are ordered by
doc_id and place; a passage that overlaps its own earlier occurrence is reported from that one's end on; rows of a null id
are left alone; rows that repeat an id and a text are reported once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import WordHashes, materialize, shingle_hashes, small_batches, words_of

#: Words of the shortest passage that is found.
WIDTH = 50


def slide(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every ``n`` neighbours, by doubling; ``op`` is a minimum or a maximum."""
    size = 1
    while 2 * size <= n:
        x, size = op(x[:-size], x[size:]), 2 * size
    return op(x[: size - n], x[n - size :]) if size < n else x


def least_hashes(words: list[bytes], width: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each short run of words, least of them in each window of ``width`` words); needs ``width`` words at least."""
    gram = max(1, width // 3)
    h = shingle_hashes(np.fromiter((known[w] for w in words), np.uint64, len(words)), gram)
    return h, slide(h, width - gram + 1, np.minimum)


def anchors(words: list[bytes], width: int, known: WordHashes) -> np.ndarray:
    """Hashes of the places of short runs that are the least of some window, one for each place."""
    h, least = least_hashes(words, width, known)
    n = len(h) - len(least) + 1
    edge = np.zeros(n - 1, np.uint64)
    return h[slide(np.concatenate([edge, least, edge]), n, np.maximum) == h]


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of ``words_of``, in characters."""
    b = np.frombuffer(text.encode(), np.uint8)
    inside = np.concatenate([[False], ~((b == 32) | ((b >= 9) & (b <= 13))), [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    return chars[turns[::2]], chars[turns[1::2]]


def _source(docs: DataFrame, rank: str | None) -> DataFrame:
    by = F.col(rank).cast("long") if rank else F.lit(0).cast("long")
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(by.alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _anchor_rows(src: DataFrame, width: int) -> DataFrame:
    """(doc_id, anchor), a row for each place."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in it:
            ids, found = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text.encode())
                if len(words) >= width:
                    found.append(anchors(words, width, known).view(np.int64))
                    ids.append(np.full(len(found[-1]), doc, np.int64))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found))], names=["doc_id", "anchor"])

    return src.select("doc_id", "text").mapInArrow(run, "doc_id long, anchor long")


def _windows(src: DataFrame, width: int) -> DataFrame:
    """(rank, doc_id, start, end, d1, d2) of the windows whose least hash is in the row's ``anchors``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in it:
            for r, doc, text, hit in zip(*(batch.column(c).to_pylist() for c in ("rank", "doc_id", "text", "anchors")), strict=True):
                words = words_of(text.encode())
                if len(words) < width:
                    continue
                at = np.flatnonzero(np.isin(least_hashes(words, width, known)[1], np.array(hit, np.int64).view(np.uint64)))
                if not len(at):
                    continue
                normal = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                begins = np.concatenate([[0], ends[:-1] + 1])
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(normal[a:b]) for a, b in zip(begins[at].tolist(), ends[at + width - 1].tolist(), strict=True)), np.int64).reshape(-1, 2)
                starts, stops = word_spans(text)
                same = (pa.array([v] * len(at), pa.int64()) for v in (r, doc))
                yield pa.record_batch([*same, *(pa.array(c) for c in (starts[at], stops[at + width - 1], d[:, 0], d[:, 1]))], names=["rank", "doc_id", "start", "end", "d1", "d2"])

    return src.mapInArrow(run, "rank long, doc_id long, start long, end long, d1 long, d2 long")


def repeats(docs: DataFrame, width: int = WIDTH, rank: str | None = None) -> DataFrame:
    """Spans to remove: doc_id, start, end (characters of the original text), and of the span's first window kept_doc_id,
    kept_start and copies."""
    small_batches(docs.sparkSession)
    src = _source(docs, rank)
    places = materialize(_anchor_rows(src, width), "passages-anchors")
    shared = places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    by_doc = places.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    windows = _windows(src.join(by_doc, "doc_id"), width)
    # a window over equal digests moves the rows once; a grouping joined back would move and store them three times
    place = F.struct(F.coalesce("rank", F.lit(2**63 - 1)).alias("rank"), "doc_id", "start", "end")
    equal = Window.partitionBy("d1", "d2")
    out = windows.withColumn("first", F.min(place).over(equal)).withColumn("copies", F.count("*").over(equal))
    out = out.select("doc_id", "start", "end", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"), F.col("first.end").alias("kept_end"), "copies")
    out = out.where("doc_id <> kept_doc_id OR start <> kept_start")
    begin = F.when(F.col("doc_id") == F.col("kept_doc_id"), F.greatest("start", "kept_end")).otherwise(F.col("start"))
    out = out.select("doc_id", begin.alias("start"), "end", "kept_doc_id", "kept_start", "copies")
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    out = out.withColumn("_top", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.withColumn("_span", F.count_if(F.col("_top").isNull() | (F.col("start") > F.col("_top"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = out.groupBy("doc_id", "_span").agg(F.max("end").alias("end"), F.min(F.struct("start", "end", "kept_doc_id", "kept_start", "copies")).alias("w"))
    return spans.select("doc_id", "w.start", "end", "w.kept_doc_id", "w.kept_start", "w.copies")
