"""Benchmark decontamination: a broadcast hash set of normalised test n-grams is scanned over document windows.

Every hash hit is verified against the item's words before it counts. Documents are only mapped, never shuffled. A
benchmark of more than BLOCK_BYTES is broadcast block by block; every block is searched in the original texts, and what
the blocks found is put together before anything is counted or cut, so results don't depend on the block size.

Defined cases: a null or empty text has no words and no hits; an item without words, or of a null id, matches nothing; an
item of fewer words than the window is one window of its own length; items that repeat an id count once; repeated document
rows each get a row of their own; other columns of either table are ignored or, in ``clean``, passed on; empty tables give
no rows or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from terrane.llm.common import WordHashes, drop_table, materialize, raw_texts, shingle_hashes, small_batches

#: ASCII bytes that are no word bytes become spaces and A-Z lower case; bytes from 0x80 on belong to words.
_TABLE = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))

#: UTF-8 bytes of benchmark text that one broadcast block holds at most, but for a single longer item. A task's index of a
#: block takes about thirty times as much: 16 bytes for each window, and its words.
BLOCK_BYTES = 8 << 20


def words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text in which A-Z are lower-cased."""
    return raw.translate(_TABLE).split()


class WindowIndex:
    """Hash set of an item block's windows. The windows are sorted hashes and places in the block's words, which verify."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        hashes, self.words, self.owner = WordHashes(), [], []
        one: dict[bytes, bytes] = {}
        by_width: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, raw in items:
            w = [one.setdefault(x, x) for x in words(raw)]
            if not w:
                continue
            n = min(width, len(w))
            by_width.setdefault(n, []).append((shingle_hashes(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)), n), len(self.words)))
            self.words += w
            self.owner += [item_id] * len(w)
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, parts in by_width.items():
            h, at = np.concatenate([h for h, _ in parts]), np.concatenate([np.arange(start, start + len(h)) for h, start in parts])
            order = np.argsort(h, kind="stable")
            self.sorted[n] = h[order], at[order]

    def hits(self, w: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words lie inside an occurrence of a window, and the items with occurring windows."""
        marks, found = np.zeros(len(w) + 1, np.int32), set()
        for n, (known, place) in self.sorted.items():
            if len(w) < n:
                continue
            h = shingle_hashes(codes, n)
            first = np.searchsorted(known, h)
            first[first == len(known)] = 0
            for i in np.flatnonzero(known[first] == h).tolist():
                own, code, hit = w[i : i + n], h[i], False
                k = int(first[i])
                while k < len(known) and known[k] == code:
                    p = int(place[k])
                    if self.owner[p] not in found or not hit:
                        if self.words[p : p + n] == own:
                            found.add(self.owner[p])
                            hit = True
                    k += 1
                if hit:
                    marks[i] += 1
                    marks[i + n] -= 1
        return np.cumsum(marks[:-1]) > 0, found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """The stated test set, in blocks of at most BLOCK_BYTES (an item is never cut); the driver holds one at a time. An empty
    set is one empty block."""
    block: list[tuple[int, bytes]] = []
    held, any_ = 0, False
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    for r in rows.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        raw = r.t.encode()
        if held and held + len(raw) > BLOCK_BYTES:
            yield block
            block, held, any_ = [], 0, True
        block.append((r.i, raw))
        held += len(raw)
    if block or not any_:
        yield block


def _spans(hit: np.ndarray) -> list[int]:
    """Flat [start, end, start, end ...] of the runs of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edge.tolist()


def _word_spans(raw: bytes) -> list[tuple[int, int]]:
    """Byte range of each word."""
    b = np.frombuffer(raw.translate(_TABLE), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([0], b.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _marked(docs: DataFrame, benchmark: DataFrame, width: int, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """``docs`` with __n (words), __runs (flat starts and ends of runs of hit words) and __items (ids of items that occur).

    Each block is one more pass over the rows; the rows between two passes are written to the shared folder, so that a task
    holds one block's index at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = docs.columns
    marks = StructType([StructField("__n", LongType()), StructField("__runs", ArrayType(IntegerType())), StructField("__items", ArrayType(LongType()))])
    out, before = docs, None
    for turn, block in enumerate(_blocks(benchmark, item_id, item_text)):
        if turn:
            out = materialize(out, "decontaminate-marked")
            if before is not None:
                drop_table(before)
            before = out
        shipped = spark.sparkContext.broadcast(block)

        def run(it: Iterator[pa.RecordBatch], shipped=shipped, turn=turn) -> Iterator[pa.RecordBatch]:
            index, hashes = WindowIndex(shipped.value, width), WordHashes()
            for batch in it:
                n, runs, items = [], [], []
                for i, raw in enumerate(raw_texts(batch.column(text_col))):
                    w = words(raw)
                    hit, found = index.hits(w, np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)))
                    if turn:
                        for a, b in _pairs(batch.column("__runs")[i].as_py()):
                            hit[a:b] = True
                        found |= set(batch.column("__items")[i].as_py())
                    n.append(len(w))
                    runs.append(_spans(hit))
                    items.append(sorted(found))
                yield pa.record_batch([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], names=[*names, *marks.names])

        out = out.mapInArrow(run, StructType([*docs.schema.fields, *marks.fields]))
    return out


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: id, n_words, runs of hit words (flat starts and ends) and the ids of the items that occur."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = _marked(src, benchmark, width, "text", item_id, item_text)
    return out.select("doc_id", F.col("__n").alias("n_words"), F.col("__runs").alias("runs"), F.col("__items").alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    covered = F.aggregate("runs", F.lit(0), lambda n, x: x - n)  # starts and ends in turn: what remains is ends less starts
    return scan(docs, benchmark, width).select(
        "doc_id",
        "n_words",
        covered.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string")))), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_share: float = 0.5) -> DataFrame:
    """Documents without what leaked from the benchmark: the hit spans are cut out of each text, and a document of which
    more than ``max_share`` of the words are hit goes as a whole. Columns stay as they are; ``n_chars``, if there, follows
    the text.
    """
    names = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep, texts, lengths = [], [], []
            old = batch.column("text").to_pylist()
            for text, raw, n, flat in zip(old, raw_texts(batch.column("text")), batch.column("__n").to_pylist(), batch.column("__runs").to_pylist(), strict=True):
                runs = _pairs(flat)
                keep.append(sum(b - a for a, b in runs) <= max_share * n)
                if runs:
                    at, pieces, last = _word_spans(raw), [], 0
                    for a, b in runs:
                        pieces.append(raw[last : at[a][0]])
                        last = at[b - 1][1]
                    text = b"".join([*pieces, raw[last:]]).decode("utf-8", "replace")
                texts.append(text)
                lengths.append(None if text is None else len(text))
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array(lengths, pa.int64()).cast(batch.schema.field("n_chars").type)
            yield pa.record_batch([new.get(c, batch.column(c)) for c in names], names=names).filter(pa.array(keep, pa.bool_()))

    return _marked(docs, benchmark, width, "text", "item_id", "text").mapInArrow(run, docs.schema)


def items_digest(items: list[int]) -> str:
    """The digest column's value for a list of item ids; for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


REPORT_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rk, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i:i+least(10, len(words))-1], ' ') AS win
       FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words)-9) + 1)) AS i FROM b WHERE len(words) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rk, i, n, array_to_string(words[i:i+n-1], ' ') AS win
       FROM (SELECT rk, words, n, unnest(range(1, len(words)-n+2)) AS i FROM w, ns WHERE len(words) >= n)),
h AS (SELECT rk, i, n, item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT rk, count(*) AS n_hit FROM (SELECT DISTINCT rk, unnest(range(i, i+n)) AS p FROM h) GROUP BY rk),
it AS (SELECT rk, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS d FROM (SELECT DISTINCT rk, item_id::VARCHAR AS s FROM h) GROUP BY rk)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(d, sha256('')) AS items_sha256, n_items IS NOT NULL AS contaminated
FROM w LEFT JOIN hit USING (rk) LEFT JOIN it USING (rk)
"""
