"""Spelling variants: words one letter apart, found by integer keys of their deletions.

Counting: each partition adds up its words and sends a count for each, so a frequent word is a row a task. Search: the letters of
all words of one length form a NumPy matrix; polynomial hashes of all prefixes and suffixes give the hash of a word without its
letter i as prefix(i) * base^(rest) + suffix(i + 1), for all words and places at once. These keys, with place and a word number,
are narrow integers; they are dealt by key and sorted, and a run of equal keys tells which rows can meet:

* words of one length are a replacement apart if and only if they agree without the letter at the same place;
* a word is an insertion apart from a longer one if and only if it is that one without a letter. In a run of equal letters
  only the first is taken out, so a pair is met once.

Only rows that meet fetch their words, and strings decide: rows are grouped anew by the shortened word itself, so a collision of
hashes joins nothing. Words that agree but for one place differ in that letter alone, so such a group has no more members than
the alphabet has letters (90), and one around a shorter word no more than 90 for each place. No pairs are formed: a group's
size and its two most frequent words tell each member how many neighbours it has and which is the most frequent.

Defined cases: a null or empty text has no words; a null id hashes as an empty one; rows that repeat an id count once each; ties go
to the smaller word in code-point order; a word's length is not bounded, as keys carry numbers and not words; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import batches_of, drop_table, materialize, mix64, raw_texts, small_batches

#: A run of a document whose hash this divides loses a letter.
EVERY = 199
LEAST_LETTERS, LEAST_COUNT, FACTOR = 6, 5, 5
#: Distinct words that a task holds before it sends their counts.
HELD_WORDS = 200_000
#: Words whose keys are made in one go, and keys of one batch at most.
KEYS_PER_BATCH = 200_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def altered(doc: bytes, run: str, every: int) -> str:
    """The run, without one letter if ``every`` divides the hash of document and run."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc + b":"))
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, every: int = EVERY, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) for words of at least ``letters`` code points that occur ``least`` times."""
    small_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run shorter than that gives no word; a match can only begin where a run begins
        find, held = re.compile(f"[a-zÀ-ÿ]{{{letters},}}").findall, Counter()

        def sent() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in it:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True):
                name = b"" if doc is None else b"%d" % doc
                for found, n in Counter(find(raw.lower().decode("utf-8", "replace"))).items():
                    word = altered(name, found, every)
                    if len(word) >= letters:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield sent()
        if held:
            yield sent()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def deletion_keys(letters: np.ndarray) -> np.ndarray:
    """Hash of each word (a row of code points) without the letter of each column, by prefix and suffix hashes."""
    words, length = letters.shape
    x = mix64(letters.astype(np.uint64) + np.uint64(1))
    power = np.ones(length + 1, np.uint64)
    power[1:] = np.cumprod(np.full(length, _BASE))
    before, after = np.zeros((words, length + 1), np.uint64), np.zeros((words, length + 1), np.uint64)
    for i in range(length):
        before[:, i + 1] = before[:, i] * _BASE + x[:, i]
        k = length - 1 - i
        after[:, k] = x[:, k] * power[i] + after[:, k + 1]
    return mix64(before[:, :length] * power[length - 1 :: -1][:length] + after[:, 1:])


def whole_key(letters: np.ndarray) -> np.ndarray:
    """The same hash of each whole word."""
    h = np.zeros(len(letters), np.uint64)
    for column in letters.T:
        h = h * _BASE + mix64(column.astype(np.uint64) + np.uint64(1))
    return mix64(h)


#: ``slot`` of a key: -1 for the word itself, else twice the place of the deleted letter, and 1 more if the letter before it is another one.
WHOLE = -1


def keys(words: DataFrame) -> DataFrame:
    """(key, slot, wid) for each word itself and for each of its letters."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it):
            texts, wid = batch.column("word").to_pylist(), batch.column("wid").to_numpy()
            size = np.array([len(w) for w in texts])
            for length in np.unique(size):
                own, step = np.flatnonzero(size == length), max(1, KEYS_PER_BATCH // int(length))
                for k in range(0, len(own), step):
                    part = own[k : k + step]
                    letters = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le"), "<u4").reshape(len(part), length)
                    place = np.arange(length, dtype=np.int32) * 2 + np.ones_like(letters, np.int32)
                    place[:, 1:] -= letters[:, 1:] == letters[:, :-1]
                    made = np.column_stack([whole_key(letters), deletion_keys(letters)])
                    slot = np.column_stack([np.full(len(part), WHOLE, np.int32), place])
                    yield pa.record_batch([pa.array(made.reshape(-1).view(np.int64)), pa.array(slot.reshape(-1)), pa.array(np.repeat(wid[part], length + 1))], names=["key", "slot", "wid"])

    return words.select("word", "wid").mapInArrow(run, "key long, slot int, wid long")


def _meeting(key: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key and slot: those with a partner at their own place, and those with one of the other length."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    place = slot >> 1  # -1 stays -1
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])]))
    alike = np.repeat(np.diff(np.append(edge, len(key))) > 1, np.diff(np.append(edge, len(key)))) & (place >= 0)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    long_one = (slot >= 0) & (slot & 1 == 1)
    both = (np.add.reduceat(long_one.astype(np.int64), edge) > 0) & (np.add.reduceat((slot == WHOLE).astype(np.int64), edge) > 0)
    other = np.repeat(both, np.diff(np.append(edge, len(key)))) & (long_one | (slot == WHOLE))
    return alike, other


def meetings(rows: DataFrame) -> DataFrame:
    """(wid, place, kind) of the rows that meet another: kind 'same' for a replacement at ``place``, 'long' for a word that gives a
    shorter one without that letter, 'short' for a word that a longer one gives."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the last key, which the next batch may go on with
        for batch in batches_of(it):
            now = [batch.column(c).to_numpy() for c in ("key", "slot", "wid")]
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            stop = np.searchsorted(now[0], now[0][-1], side="left")
            rest = [x[stop:].copy() for x in now]
            yield from found(*(x[:stop] for x in now))
        if rest is not None:
            yield from found(*rest)

    def found(key: np.ndarray, slot: np.ndarray, wid: np.ndarray) -> Iterator[pa.RecordBatch]:
        alike, other = _meeting(key, slot)
        if alike.any() or other.any():
            kinds = ["same"] * int(alike.sum()) + ["short" if s == WHOLE else "long" for s in slot[other].tolist()]
            yield pa.record_batch([pa.array(np.concatenate([wid[alike], wid[other]])), pa.array(np.concatenate([slot[alike], slot[other]]) >> 1), pa.array(kinds)], names=["wid", "place", "kind"])

    dealt = rows.repartition(F.shiftright("key", 32)).sortWithinPartitions("key", "slot")  # radix: the upper half deals, the sort orders the rest
    return dealt.mapInArrow(run, "wid long, place int, kind string")


def _by_count(n: Column | str = "n", word: Column | str = "word") -> Column:
    """Orders words by falling count, then rising code points."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def neighbours(words: DataFrame, hits: DataFrame) -> DataFrame:
    """(word, n_near, best) for words with a neighbour; ``best`` is the (less, word) of the most frequent one."""
    rows = hits.join(words, "wid")
    without = F.expr("concat(substring(word, 1, place), substring(word, place + 2))")
    rows = rows.select("word", "n", "kind", F.when(F.col("kind") == "short", F.col("word")).otherwise(without).alias("rest"), F.when(F.col("kind") == "same", F.col("place")).otherwise(-1).alias("place"))
    group = Window.partitionBy("rest", "place")
    ordered = group.orderBy(F.when(F.col("kind") == "short", 1).otherwise(0), F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = _by_count()
    rows = rows.select(
        "word", "kind", me.alias("me"), F.count("*").over(group).alias("size"),
        F.max(F.when(F.col("kind") == "short", me)).over(group).alias("short"), F.first(me).over(ordered).alias("one"), F.nth_value(me, 2).over(ordered).alias("two"),
    )
    has_short = F.col("short").isNotNull()
    near = F.when(F.col("kind") == "long", F.when(has_short, 1).otherwise(0)).otherwise(F.col("size") - 1)
    best = F.when(F.col("kind") == "long", F.col("short")).when(F.col("kind") == "short", F.when(F.col("size") > 1, F.col("one"))).when(F.col("one.word") != F.col("word"), F.col("one")).otherwise(F.col("two"))
    return rows.select("word", near.alias("near"), best.alias("best")).where("near > 0").groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain. Counts rise along a chain, so there is none without an end; each
    round doubles the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_table(now)
        moved, now = not after.where("moved").isEmpty(), after.drop("moved")
        if not moved:
            return now


def variants(docs: DataFrame, every: int = EVERY, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """word, form (most frequent near word, if ``factor`` times as frequent), root, n, n_near, form_n."""
    words = materialize(count_words(docs, every, letters, least).select("word", "n", F.xxhash64("word").alias("wid")), "spelling-words")
    near = neighbours(words, meetings(keys(words)))
    form = F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best"))
    told = materialize(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form["word"].alias("form"), (-form["less"]).alias("form_n")), "spelling-told")
    drop_table(words)
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same words with a bytewise checksum; neighbours by the shortened strings themselves.
VARIANTS_SQL = r"""
WITH RECURSIVE
tab AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS k, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))) AS x FROM found WHERE length(run) >= 6 GROUP BY doc_id, run),
sums AS (SELECT run, k, xor(list_reduce(list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
                              lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS h FROM runs, tab),
words AS MATERIALIZED (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
          FROM sums GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
told AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
         FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS root FROM told UNION ALL SELECT w.word, t.form FROM walk w JOIN told t ON t.word = w.root WHERE t.form IS NOT NULL)
SELECT t.word, t.form, w.root, CAST(t.n AS BIGINT) AS n, CAST(t.n_near AS BIGINT) AS n_near, CAST(t.form_n AS BIGINT) AS form_n
FROM told t JOIN walk w USING (word) JOIN told e ON e.word = w.root AND e.form IS NULL"""
