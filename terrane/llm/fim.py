"""Fill-in-middle transformation by overlapping chunks.

A token ends where a character that is no white space meets white space, so the places where a text may be cut are a predicate
on adjacent characters. All texts of a batch lie in one byte array that is dealt into chunks; a chunk overlaps the one before by
one byte, so it knows its own boundaries without any other chunk. Boundaries are counted per chunk in one vectorised pass, prefix
sums over the chunks give each text's token count and route both cut ranks to the chunks that own them, and only those chunks
are scanned again for the places of the cuts. UTF-8 is never decoded for it: white space is ASCII, and no byte of a longer
character looks like it.

Spark deals the rows; a batch is a few megabytes, a longer text is a batch of its own, and nothing is shuffled.

Defined cases: a null text counts as empty and stays plain, with 0 tokens; a row of a null id has no draws and stays plain; rows
that repeat an id draw alike and are transformed once each; a text that holds a marker stays plain; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import raw_texts, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK_BYTES = 4096
#: Percent of texts that are transformed, and of those the percent in suffix-first order.
FIM_PERCENT, SPM_PERCENT, SEED = 50, 80, 42

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Boundaries:
    """Cut places of texts that lie one after the other in one array: cut k of a text stands before its token k, counted from 0."""

    def __init__(self, texts: list[bytes], chunk: int = CHUNK_BYTES):
        self.size = np.array([len(x) for x in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.space, self.chunk = _SPACE[np.frombuffer(b"".join(texts), np.uint8)], chunk
        pieces = -(-self.size // chunk)
        self.first = np.cumsum(pieces) - pieces  # a text's first chunk
        owner = np.repeat(np.arange(len(texts)), pieces)
        self.lo = self.start[owner] + (np.arange(len(owner)) - self.first[owner]) * chunk
        self.hi = np.minimum(self.lo + chunk, self.start[owner] + self.size[owner])
        counts = np.add.reduceat(self._ends(0, len(self.space), self.start[self.size > 0]), self.lo) if len(owner) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])  # boundaries of all chunks before each chunk
        last = self.first + pieces
        self.tokens = self.before[last] - self.before[self.first] + (self.size > 0)

    def _ends(self, lo: int, hi: int, text_starts: np.ndarray) -> np.ndarray:
        """1 where white space follows another character, read with one byte of overlap; a text's first byte is no boundary."""
        out = self.space[lo:hi].astype(np.int64)
        out[1:] &= ~self.space[lo : hi - 1]
        if lo:
            out[:1] &= ~self.space[lo - 1]
        out[text_starts - lo] = 0
        return out

    def cuts(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Byte place, within its text, where ``rank`` tokens end."""
        out = np.where(rank <= 0, 0, self.size[text])
        inner = np.flatnonzero((rank > 0) & (rank < self.tokens[text]))
        goal = self.before[self.first[text[inner]]] + rank[inner]
        own = np.searchsorted(self.before, goal, side="left") - 1
        for i, t, g, c in zip(inner, text[inner], goal, own, strict=True):
            lo, hi = self.lo[c], self.hi[c]
            ends = np.flatnonzero(self._ends(lo, hi, np.array([lo] if lo == self.start[t] else [], np.int64)))
            out[i] = lo + ends[g - self.before[c] - 1] - self.start[t]
        return out


def draws(doc_id: int, seed: int = SEED) -> list[int]:
    """The first four 32-bit groups of the digest of seed and id."""
    digest = hashlib.sha256(b"%d:%d" % (seed, doc_id)).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transform(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, chunk: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    small_batches(docs.sparkSession)
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = markers

    def one(raw: bytes, a: int, b: int, form: str) -> tuple[int | None, int | None, bytes]:
        if form == "plain":
            return None, None, raw
        pre, mid, suf = raw[:a], raw[a:b], raw[b:]
        out = b"".join((p, pre, s, suf, m, mid) if form == "psm" else (s, suf, p, pre, m, mid))
        return len(pre.decode("utf-8", "replace")), len(mid.decode("utf-8", "replace")), out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, ids = raw_texts(batch.column("text")), batch.column("doc_id").to_pylist()
            where = Boundaries(texts, chunk)
            n = where.tokens
            h = np.array([[0, 0, 100, 0] if i is None else draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
            drawn = h[:, 2] % 100 < fim_percent
            drawn &= np.array([i is not None and bool(x) and not any(mark in x for mark in markers) for i, x in zip(ids, texts, strict=True)], bool)
            form = np.where(drawn, np.where(h[:, 3] % 100 < spm_percent, "spm", "psm"), "plain")
            ranks, every = h[:, :2] % (n + 1)[:, None], np.flatnonzero(drawn)
            a, b = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            a[every], b[every] = where.cuts(every, ranks[every].min(1)), where.cuts(every, ranks[every].max(1))
            made = [one(x, i, j, f) for x, i, j, f in zip(texts, a.tolist(), b.tolist(), form.tolist(), strict=True)]
            pre, mid, out = zip(*made, strict=True) if made else ((), (), ())
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(pre, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.binary()).cast(pa.string(), safe=False)]
            yield pa.record_batch(arrays, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of. A transformed text holds no marker, and no marker can arise where parts meet, as a marker
    begins with a character that stands nowhere else in one; so an output has exactly its three markers."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The transformed rows with digests of the output and of the text rebuilt from it."""
    out = transform(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: Same tokens by the pattern itself, cut by list slices.
DIGESTS_SQL = r"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
u AS (SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
             CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
f AS (SELECT *, CASE WHEN doc_id IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                     WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p"""
