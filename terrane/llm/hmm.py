"""Hidden Markov language model over words.

Corpus counts of all training words come first. The states emit symbols: the end of a text, each of the most frequent
words, and for the rest one symbol for each hash class; a word's probability within its class comes from the corpus
counts, so the model is a distribution over words while its state tables stay bounded. Baum-Welch runs over all training
texts: each partition adds up expected counts, which are summed in a shuffle before the next round.

The recursions are exact for texts of any length. A text is cut into chunks; all chunks' transfer matrices are made side
by side, a scan over a text's chunks gives each chunk's entering and leaving messages, and a second sweep does the rest.

Words of the lexicon (the most frequent ones, of bounded number) are scored where the text stands. Other words are few in
each text and meet their counts in a join by word, whose keys can't be hot: frequent words are in the lexicon.

Defined cases: a null or empty text is its end alone; a null doc_id is held out; repeated rows are learned from and scored
once each; other columns are ignored; without training rows all tables are uniform and the base score is 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import materialize, raw_texts, remainder, small_batches, words_of

STATES = 6
#: Frequent words with a symbol of their own, at most.
SYMBOLS = 4096
#: Hash classes of all other words.
CLASSES = 64
#: Words whose counts are sent to every task, at most.
LEXICON = 250_000
ROUNDS = 4
#: Added to every count of a word.
SMOOTH = 0.1
CHUNK = 64


class Codes(dict):
    """Number of each word of the lexicon; other words get the lexicon's size plus their class."""

    def __missing__(self, word: bytes) -> int:
        return self.size + zlib.crc32(word) % CLASSES

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(1, len(words) + 1), strict=True))
        self.size = len(words) + 1


@dataclass
class Lexicon:
    """The end of a text (number 0, word ""), frequent words by falling count, and the totals of all words."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray
    symbols: int = field(init=False)

    def __post_init__(self) -> None:
        self.symbols = 1 + min(SYMBOLS, len(self.words))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By code: symbol, log10 probability within the symbol, base score. Codes beyond the lexicon score 0 here."""
        n = len(self.words) + 1
        classes = np.array([zlib.crc32(w) % CLASSES for w in self.words], np.int64)
        symbol = np.concatenate((np.arange(self.symbols), self.symbols + classes[self.symbols - 1 :], self.symbols + np.arange(CLASSES)))
        inside = np.zeros(n + CLASSES)
        k = symbol[self.symbols : n] - self.symbols
        inside[self.symbols : n] = np.log10((self.counts[self.symbols :] + SMOOTH) / (self.class_total[k] + SMOOTH * (self.class_distinct[k] + 1)))
        return symbol, inside, np.concatenate((self.base(self.counts), np.zeros(CLASSES)))


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    """symbols x states"""


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the rows of (text); the word "" counts the ends."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for batch in it:
            for raw in raw_texts(batch.column("text")):
                held.update(words_of(raw))
            held[b""] += batch.num_rows
            if len(held) > 200_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _class(word: Column) -> Column:
    return F.crc32(word.cast("binary")) % CLASSES


def lexicon(counts: DataFrame) -> Lexicon:
    """Totals, class totals and the most frequent words: the longest list of all words with at least some count that
    has at most LEXICON words."""
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    level = F.when(F.col("c") < 1000, F.col("c")).otherwise((1000 * (1 + F.log10(F.col("c") / 1000))).cast("long"))
    levels = counts.where("word <> ''").groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    least, held = None, 0
    for r in sorted(levels, key=lambda r: -r.level):
        held += r.n
        if held > LEXICON:
            break
        least = r.c
    rows: list[tuple[int, bytes]] = []
    if least is not None:
        frequent = counts.where((F.col("word") != "") & (F.col("c") >= least)).select(F.col("word").cast("binary").alias("word"), "c").toArrow()
        rows = sorted(zip((-c for c in frequent["c"].to_pylist()), frequent["word"].to_pylist(), strict=True))
    end = counts.where("word = ''").first()
    words = [bytes(w) for _, w in rows]
    own = rows[:SYMBOLS]
    by_class = counts.where("word <> ''").groupBy(_class(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        class_total[r.k], class_distinct[r.k] = r.c, r.n
    for c, w in own:  # words with a symbol of their own leave their class
        class_total[zlib.crc32(w) % CLASSES] += c
        class_distinct[zlib.crc32(w) % CLASSES] -= 1
    return Lexicon(words, np.array([end.c if end else 0, *(-c for c, _ in rows)], float), int(total or 0), int(distinct or 0), class_total, class_distinct)


def first_model(lex: Lexicon) -> Model:
    """Sticky steps; each state emits the corpus distribution, tilted by a fixed pseudo-random factor for each symbol."""
    rng = np.random.default_rng(20)
    unigram = np.concatenate((lex.counts[: lex.symbols], lex.class_total)) + SMOOTH
    emit = unigram[:, None] * rng.uniform(0.3, 1.7, (len(unigram), STATES))
    step = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
    return Model(np.full(STATES, 1 / STATES), step, emit / emit.sum(0))


class Sweep:
    """Chunks of a batch of symbol sequences (each of at least one symbol), longest chunk first."""

    def __init__(self, model: Model, sequences: list[np.ndarray]):
        self.model, self.n_docs = model, len(sequences)
        n = np.array([len(s) for s in sequences])
        chunks = -(-n // CHUNK)
        doc = np.repeat(np.arange(len(n)), chunks)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        length = np.minimum(CHUNK, n[doc] - turn * CHUNK)
        order = np.argsort(-length, kind="stable")
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.first, self.length, self.turns = np.cumsum(chunks) - chunks, length[order], chunks
        self.head = (turn == 0)[order]
        flat = np.concatenate(sequences)
        begin = (np.cumsum(n) - n)[doc] + turn * CHUNK
        at = np.minimum(begin[order][:, None] + np.arange(CHUNK), len(flat) - 1)
        self.symbol = flat[at]
        self.active = np.searchsorted(-self.length, -np.arange(1, CHUNK + 1), side="right")
        self._transfer()

    def _transfer(self) -> None:
        k, c = self.model.step.shape[0], len(self.length)
        x = np.broadcast_to(np.eye(k), (c, k, k)).copy()
        self.scale = np.zeros(c)
        for t in range(CHUNK):
            m = self.active[t]
            if not m:
                break
            y = (x[:m].reshape(-1, k) @ self.model.step).reshape(m, k, k)
            if t == 0:
                y[self.head[:m]] = np.eye(k)
            y *= self.model.emit[self.symbol[:m, t]][:, None, :]
            if t % 8 == 7 or t == CHUNK - 1:
                top = y.max((1, 2))
                y /= top[:, None, None]
                self.scale[:m] += np.log(top)
            x[:m] = y
        top = x.max((1, 2))
        self.matrix, self.scale = x / top[:, None, None], self.scale + np.log(top)

    def entering(self) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's entering message and each sequence's natural log-likelihood."""
        enter = np.empty((len(self.length), len(self.model.start)))
        total, alpha, going = np.zeros(self.n_docs), np.tile(self.model.start, (self.n_docs, 1)), np.arange(self.n_docs)
        turn = 0
        while len(going):
            at = self.place[self.first[going] + turn]
            enter[at] = alpha[going]
            now = np.einsum("ni,nij->nj", alpha[going], self.matrix[at])
            norm = now.sum(1)
            alpha[going] = now / norm[:, None]
            total[going] += np.log(norm) + self.scale[at]
            turn += 1
            going = going[self.turns[going] > turn]
        return enter, total

    def leaving(self) -> np.ndarray:
        """Each chunk's leaving message, up to a factor."""
        leave = np.ones((len(self.length), len(self.model.start)))
        beta, back = np.ones((self.n_docs, len(self.model.start))), 1
        going = np.arange(self.n_docs)
        while len(going):
            at = self.place[self.first[going] + self.turns[going] - back]
            leave[at] = beta[going]
            now = np.einsum("nij,nj->ni", self.matrix[at], beta[going])
            beta[going] = now / now.sum(1)[:, None]
            back += 1
            going = going[self.turns[going] >= back]
        return leave

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, steps and emissions, and the log-likelihood."""
        step, emit = self.model.step, self.model.emit
        enter, total = self.entering()
        alphas, now = np.empty((CHUNK, *enter.shape)), enter
        for t in range(CHUNK):
            m = self.active[t]
            if not m:
                break
            prior = now[:m] @ step
            if t == 0:
                prior[self.head[:m]] = now[:m][self.head[:m]]
            a = prior * emit[self.symbol[:m, t]]
            now = alphas[t, :m] = a / a.sum(1)[:, None]
        beta = self.leaving()
        starts, steps = np.zeros(len(enter[0])), np.zeros_like(step)
        emits = np.zeros(emit.shape[::-1])
        for t in reversed(range(CHUNK)):
            m = self.active[t]
            if not m:
                continue
            b = beta[:m]
            gamma = alphas[t, :m] * b
            gamma /= gamma.sum(1)[:, None]
            for k in range(len(emits)):
                emits[k] += np.bincount(self.symbol[:m, t], gamma[:, k], emits.shape[1])
            ahead = emit[self.symbol[:m, t]] * b
            prev = enter[:m] if t == 0 else alphas[t - 1, :m]
            back = ahead @ step.T
            weight = (prev * back).sum(1)
            if t == 0:
                starts += gamma[self.head[:m]].sum(0)
                inner = ~self.head[:m]
                steps += (prev[inner] / weight[inner][:, None]).T @ ahead[inner] * step
            else:
                steps += (prev / weight[:, None]).T @ ahead * step
            beta[:m] = back / back.sum(1)[:, None]
        return starts, steps, emits, float(total.sum())


#: Tokens whose messages a task holds at once, unless one text has more.
TOKENS_AT_ONCE = 300_000


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Each row of (doc_id, text, held_out) as the codes of its tokens, 32 bits each, and its other words with their counts;
    stored, so that texts are cut into words once and rounds of training read numbers only."""
    shipped = docs.sparkSession.sparkContext.broadcast(lex)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, row = Codes(shipped.value.words), TaskContext.get().partitionId() << 40
        for batch in it:
            coded, rare = [], []
            for raw in raw_texts(batch.column("text")):
                w = words_of(raw)
                c = np.fromiter((*map(codes.__getitem__, w), 0), np.int32, len(w) + 1)
                coded.append(c.tobytes())
                rare.append([{"word": x.decode("utf-8", "replace"), "n": n} for x, n in Counter(w[i] for i in np.flatnonzero(c >= codes.size).tolist()).items()])
            items = pa.array(rare, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))
            yield pa.record_batch([pa.array(np.arange(row, row + len(coded))), batch.column("doc_id"), batch.column("held_out"), pa.array(coded, pa.binary()), items], names=["row", "doc_id", "held_out", "codes", "rare"])
            row += len(coded)

    return materialize(docs.mapInArrow(run, "row long, doc_id long, held_out boolean, codes binary, rare array<struct<word:string,n:long>>"), "hmm-codes")


def _groups(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    """The code sequences of a batch, at most about TOKENS_AT_ONCE together."""
    group: list[np.ndarray] = []
    held = 0
    for raw in batch.column("codes").to_pylist():
        c = np.frombuffer(raw, np.int32)
        if group and held + len(c) > TOKENS_AT_ONCE:
            yield group
            group, held = [], 0
        group.append(c)
        held += len(c)
    if group:
        yield group


def train(coded: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the encoded rows that aren't held out."""
    spark = coded.sparkSession
    model, symbols = first_model(lex), spark.sparkContext.broadcast(lex.tables()[0].astype(np.int32))
    for _ in range(rounds if lex.total else 0):
        shipped = spark.sparkContext.broadcast(model)

        def run(it: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            symbol, sums = symbols.value, None
            for batch in it:
                for group in _groups(batch):
                    *got, total = Sweep(shipped.value, [symbol[c] for c in group]).expected()
                    got.append(np.array([total]))
                    sums = got if sums is None else [a + b for a, b in zip(sums, got, strict=True)]
            if sums is not None:
                flat = np.concatenate([x.ravel() for x in sums])
                some = np.flatnonzero(flat)
                yield pa.record_batch([pa.array(some), pa.array(flat[some])], names=["cell", "x"])

        k, m = len(model.start), len(model.emit)
        flat = np.zeros(k + k * k + k * m + 1)
        # as many rows as the model has cells
        for r in coded.where("NOT held_out").select("codes").mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
            flat[r.cell] = r.x
        starts, steps, emits = flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : -1].reshape(k, m).T
        model = Model((starts + 1) / (starts + 1).sum(), (steps + 1) / (steps + 1).sum(1)[:, None], (emits + SMOOTH) / (emits + SMOOTH).sum(0))
        shipped.unpersist()
    return model


def score(coded: DataFrame, counts: DataFrame, lex: Lexicon, model: Model) -> DataFrame:
    """Per encoded row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    tables = coded.sparkSession.sparkContext.broadcast((*lex.tables(), np.concatenate((lex.counts > 0, np.zeros(CLASSES, bool))), model))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, inside, base, known, model = tables.value
        for batch in it:
            rows: list[tuple[int, int, float, float]] = []
            for group in _groups(batch):
                total = Sweep(model, [symbol[c] for c in group]).entering()[1] / np.log(10)
                rows += [(len(c), int(known[c].sum()), float(base[c].sum()), float(t + inside[c].sum())) for t, c in zip(total, group, strict=True)]
            n, k, b, own = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(b, pa.float64()), pa.array(own, pa.float64())], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "own"])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double"
    local = coded.select("row", "doc_id", "held_out", "codes").mapInArrow(run, schema)
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    at = (_class(F.col("word")) + 1).cast("int")
    room = F.element_at(F.array(*(F.lit(float(x)) for x in lex.class_total + SMOOTH * (lex.class_distinct + 1))), at)
    rest = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((c + SMOOTH) / F.lit(lex.total + SMOOTH * (lex.distinct + 1)))).alias("more_base"),
        F.sum(F.col("n") * F.log10((c + SMOOTH) / room)).alias("more_own"),
    )
    out = local.join(rest, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("own") + F.coalesce("more_own", F.lit(0.0))).alias("score"),
    )


def language_model(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Learn from the rows whose crc32 of the id leaves a remainder other than 0, and score all rows."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(True))
    counts = materialize(count_words(src.where(~held)), "hmm-counts")
    lex = lexicon(counts)
    coded = encode(src.withColumn("held_out", held), lex)
    return score(coded, counts, lex, train(coded, lex, rounds))
