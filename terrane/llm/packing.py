"""Packing by concatenate and cut.

First pass: each partition tokenises its documents and stores the ids with each document's place among the partition's
own tokens. The partitions' totals, one row each, are summed into global offsets. Second pass: every document is cut
where a window of the one global token stream ends; a piece's sequence and offset are arithmetic on its global position,
so no row ever moves and each piece is its own boundary record. Only the last window can have padding.

Defined cases: a null or empty text is one end id; repeated rows are packed once each; other columns are ignored; an
empty table gives no pieces; a document longer than a window spans several.
"""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrane.llm.common import materialize, raw_texts, small_batches

SEQUENCE = 1024
#: Input partitions up to which their offsets, one row each, are broadcast.
BROADCAST_PARTS = 1_000_000


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


class _Chunks(dict):
    """Ids, as little-endian unsigned 32-bit, of a space and then the chunk that is the key."""

    LIMIT = 250_000

    def __init__(self, parts: tiktoken.Encoding):
        self.encode = parts.encode_ordinary

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        ids = self[chunk] = array("I", self.encode(" " + chunk.decode("utf-8", "replace"))).tobytes()
        return ids


class ChunkEncoder:
    """Byte-level BPE of whole texts, by chunks whose ids are remembered.

    The vocabulary's splitting rule never joins characters across the place before a single space that stands between
    two other characters: letters, digits and signs take one leading space, and a run of white space ends before its last
    space. So the text is cut there and each chunk is looked up. A chunk that is new is encoded by the same vocabulary's
    rank file, which is faster than the tokenizer for short strings and gives the same ids (tests compare them). Texts
    with the special token's own string, with space at their ends or next to other white space, and with white space
    beyond space and newline go to the tokenizer whole.
    """

    SPACED = (b"  ", b" \n", b"\n ", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
    RARE = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        ranks_file = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_file):
            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.parts = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.chunks = _Chunks(self.parts)
        else:
            self.parts = None

    def whole(self, raw: bytes) -> bytes:
        return array("I", self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def plain(self, raw: bytes) -> bool:
        return not (raw[:1] == b" " or raw[-1:] == b" " or any(s in raw for s in self.SPACED) or any(s in raw for s in self.special)) and len(raw.translate(None, self.RARE)) == len(raw)

    def encode(self, raw: bytes) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit."""
        if self.parts is None or not self.plain(raw):
            return self.whole(raw)
        head, *rest = raw.split(b" ")
        return array("I", self.parts.encode_ordinary(head.decode("utf-8", "replace"))).tobytes() + b"".join(map(self.chunks.__getitem__, rest))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each tokenizer file and Python worker; its memory outlives a task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def tokenise(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass, stored: doc_id, part, at (tokens of the partition before the document), n_tokens, ids (16 bits each, or
    32 for a vocabulary beyond that)."""
    small_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at, part = encoder(path), 0, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in it:
            ids = [enc.encode(raw) + end for raw in raw_texts(batch.column("text"))]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), pa.array([_narrow(x) for x in ids], pa.binary())], names=["doc_id", "part", "at", "n_tokens", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(src.mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids binary"), "packing-tokens")


def _narrow(wide: bytes) -> bytes:
    """A leading byte 2 or 4 tells the width of the ids that follow."""
    ids = np.frombuffer(wide, "<u4")
    return b"\2" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\4" + wide


def _wide(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[0] == 2 else "<u4", offset=1).astype("<u4")


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, with_ids: bool = False, end_id: int = 0) -> DataFrame:
    """Pieces of the packed stream: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves
    with ``with_ids``. A window of ``sequence`` tokens is one sequence."""
    tokens = tokenise(docs, path or tokenizer_file(), end_id)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each input partition: a running sum over a table that small may stand in one task
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    base = F.broadcast(base) if totals.count() <= BROADCAST_PARTS else base  # else the ids would be dealt by partition number
    placed = tokens.join(base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("place"), "n_tokens", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cols: list[list] = [[] for _ in range(7 + with_ids)]
            for doc, place, n, stored in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, first = _wide(stored), sequence - place % sequence
                edges = [0, *range(first, n, sequence), n]
                for a, b in zip(edges, edges[1:], strict=False):
                    row = [doc, a, b - a, zlib.crc32(ids[a:b]), n, (place + a) // sequence, (place + a) % sequence]
                    for c, v in zip(cols, row + ([ids[a:b].tolist()] if with_ids else []), strict=True):
                        c.append(v)
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(c, pa.list_(pa.int32())) for c in cols[7:]]
            yield pa.record_batch(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

    return placed.mapInArrow(cut, schema)
