"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Every symbol has a sparse random index vector. A symbol's word vector is the sum of the index vectors of its neighbours
over the whole corpus: each partition adds up its own sums, which meet in one grouped sum. Symbols are the most frequent
words and, for all other tokens, classes of their shape (case, trailing signs, length), so the tables are bounded and
every token counts. A document is pooled as the mean word vector of its tokens, that of its distinct symbols, and two
scalars (length and share of distinct symbols). The network is fitted on a bounded sample of labelled documents
(labelled.SAMPLE_ROWS); a fifth of them is left out to choose the temperature that calibrates its probabilities.

Defined cases: a null or empty text is pooled as zeros and scored like any other; a null doc_id is scored and counts as
held out; repeated rows are scored once each; other columns are ignored; without labels of both classes every score is
the share of label 1, or 0.5 without labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import materialize, raw_texts, remainder, small_batches
from terrane.llm.hmm import count_words
from terrane.llm.labelled import sample

#: Frequent words with a vector of their own, at most; shape classes of the rest.
WORDS, SHAPES = 2_000, 512
#: Width of the vectors, signs other than 0 in an index vector, neighbours to each side.
WIDTH, SIGNS, REACH = 48, 4, 2
HIDDEN, EPOCHS = 32, 400


class Symbols(dict):
    """Number of each token; remembers what it has seen, up to a bound."""

    LIMIT = 300_000

    def __init__(self, words: list[bytes]):
        self.words = {w: i for i, w in enumerate(words)}
        self.size = len(words) + SHAPES

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        n = self.words.get(token, self.words.get(token[:1].lower() + token[1:]))
        if n is None:
            text = token.decode("utf-8", "replace")
            core = text.rstrip("".join({c for c in text if not c.isalnum()}))
            case = "X" if core.isupper() and len(core) > 1 else "x" if core.islower() else "Xx" if core[:1].isupper() and core[1:].islower() else "0" if core.isdigit() else "?"
            shape = f"{case}{text[len(core):][:4]}{min(len(core), 32).bit_length()}"
            n = len(self.words) + zlib.crc32(shape.encode()) % SHAPES
        self[token] = n
        return n


def index_vectors(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each symbol's index vector, the same in every task."""
    rng = np.random.default_rng(48)
    return rng.integers(0, WIDTH, (size, SIGNS)), rng.choice([-1.0, 1.0], (size, SIGNS))


def frequent_words(docs: DataFrame) -> list[bytes]:
    """The WORDS most frequent words of all texts, A-Z lower-cased; ties in order of the word."""
    rows = count_words(docs).where("word <> ''").orderBy(F.desc("c"), "word").limit(WORDS).collect()
    return [r.word.encode() for r in rows]


def word_vectors(docs: DataFrame, words: list[bytes]) -> np.ndarray:
    """Unit vectors by symbol, from the neighbours of every token of every text."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)
    names = [f"d{i}" for i in range(WIDTH)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(shipped.value)
        place, sign = index_vectors(symbols.size)
        sums = np.zeros((symbols.size, WIDTH))
        for batch in it:
            seen = [np.fromiter(map(symbols.__getitem__, w), np.int64, len(w)) for w in map(bytes.split, raw_texts(batch.column("text")))]
            # texts stand apart, so that neighbours never come from another one
            gap = np.full(REACH, -1)
            flat = np.concatenate([x for s in seen for x in (s, gap)]) if seen else gap
            for off in range(1, REACH + 1):
                a, b = flat[:-off], flat[off:]
                both = (a >= 0) & (b >= 0)
                for x, y in ((a[both], b[both]), (b[both], a[both])):
                    for k in range(SIGNS):
                        sums += np.bincount(x * WIDTH + place[y, k], sign[y, k], sums.size).reshape(sums.shape)
        some = np.flatnonzero(np.abs(sums).sum(1))
        yield pa.record_batch([pa.array(some, pa.int64()), *(pa.array(sums[some, i]) for i in range(WIDTH))], names=["symbol", *names])

    schema = "symbol long, " + ", ".join(f"{n} double" for n in names)
    total = docs.select("text").mapInArrow(run, schema).groupBy("symbol").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((len(words) + SHAPES, WIDTH))
    out[total["symbol"].to_numpy()] = np.stack([total[n].to_numpy() for n in names], 1) if total.num_rows else 0
    return out / np.maximum(np.sqrt((out**2).sum(1)), 1e-9)[:, None]


def pool(raw: bytes, symbols: Symbols, vectors: np.ndarray) -> np.ndarray:
    tokens = raw.split()
    n = np.bincount(np.fromiter(map(symbols.__getitem__, tokens), np.int64, len(tokens)), minlength=symbols.size)
    some = np.flatnonzero(n)
    if not len(some):
        return np.zeros(2 * WIDTH + 2)
    v, c = vectors[some], n[some]
    return np.concatenate((c @ v / c.sum(), v.mean(0), [np.log1p(c.sum()) / 10, len(some) / min(c.sum(), symbols.size)]))


@dataclass
class Network:
    """Two layers, and the temperature that divides the logit."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log-likelihood of four fifths of the rows; temperature by the likelihood of the rest."""
    rng = np.random.default_rng(7)
    width = 2 * WIDTH + 2
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        edge = np.clip(share, 1e-6, 1 - 1e-6)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(edge / (1 - edge))))
    order = rng.permutation(len(y))
    kept, rest = order[len(y) // 5 :], order[: len(y) // 5]
    net = Network(x[kept].mean(0), x[kept].std(0) + 1e-6, rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    s, t = (x[kept] - net.mean) / net.spread, y[kept]
    for epoch in range(1, EPOCHS + 1):
        h = np.tanh(s @ net.w1 + net.b1)
        d = (1 / (1 + np.exp(-(h @ net.w2 + net.b2))) - t) / len(t)
        back = d[:, None] * net.w2 * (1 - h**2)
        grads = [s.T @ back + 1e-4 * net.w1, back.sum(0), h.T @ d + 1e-4 * net.w2, np.array([d.sum()])]
        moves = []
        for pair, g in zip(state, grads, strict=True):
            pair[0], pair[1] = 0.9 * pair[0] + 0.1 * g, 0.999 * pair[1] + 0.001 * g**2
            moves.append(0.02 * (pair[0] / (1 - 0.9**epoch)) / (np.sqrt(pair[1] / (1 - 0.999**epoch)) + 1e-8))
        net.w1, net.b1, net.w2, net.b2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2], float(net.b2 - moves[3][0])
    if len(rest):
        z = net.logit(x[rest])
        loss = lambda at: np.logaddexp(0, -np.where(y[rest] > 0, z, -z) / at).sum()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def report(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, cut: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Labels of the held-out fold are not learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = frequent_words(src)
    shipped = spark.sparkContext.broadcast((words, word_vectors(src, words).astype(np.float32)))

    def pooled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors = shipped.value
        symbols = Symbols(words)
        for batch in it:
            rows = [pool(raw, symbols, vectors).astype(np.float32).tobytes() for raw in raw_texts(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "x"])

    vectors = materialize(src.mapInArrow(pooled, "doc_id long, x binary"), "quality-vectors")
    learn: Column = remainder(F.col("doc_id"), folds) != fold
    rows = vectors.join(F.broadcast(sample(labels, "quality", learn)), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    net = spark.sparkContext.broadcast(fit(_stack(rows["x"].to_pylist()), np.array(rows["y"].to_pylist(), float)))

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.record_batch([batch.column("doc_id"), pa.array(net.value.probability(_stack(batch.column("x").to_pylist())), pa.float64())], names=["doc_id", "score"])

    held = F.coalesce(~learn, F.lit(True))
    return vectors.mapInArrow(scored, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _stack(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, 2 * WIDTH + 2).astype(np.float64)
