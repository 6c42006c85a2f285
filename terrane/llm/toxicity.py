"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the weights of its words, and a
document's probability is the noisy-or of its sentences: one minus the product of what each leaves. Weights are learned
from document labels alone, by gradient descent on the documents' log-likelihood; sentences are never labelled. The same
sentence scores then locate the offending sentences.

A sentence without any word of the vocabulary has score 0, and a small leak stands for labels that no sentence explains,
so that a long clean document doesn't add up to a toxic one. The vocabulary holds words that stand in toxic documents
more often than chance allows.

The model is fitted on a bounded sample (labelled.SAMPLE_ROWS rows, and SAMPLE_BYTES of text); every document is scored.

Defined cases: a null or empty text, or one without known words, gets the leak as its score; a null doc_id is scored and
counts as held out; repeated rows are scored once each; other columns are ignored or, in ``remove_toxic``, passed on;
without labels of both classes every score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import raw_texts, remainder, small_batches
from terrane.llm.labelled import sample

#: UTF-8 bytes of sampled text that the fit holds, at most.
SAMPLE_BYTES = 48 << 20
#: Words of the vocabulary, at most; documents of the sample that a word must stand in, at least.
VOCABULARY, LEAST_DOCS = 2_000, 4
STEPS = 200
#: Weight of a toxic document in the fit, against the rarer class's being given up for the common one.
TOXIC_WEIGHT = 5.0

#: Bytes that end a sentence become newlines, other ASCII bytes beyond letters and digits become spaces, A-Z lower case.
_TABLE = bytes(c if c >= 0x80 else 10 if chr(c) in ".!?\n" else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = 0.0
    leak: float = 0.0

    def sentences(self, raw: bytes) -> list[tuple[int, int, float]]:
        """(start, end, score) in bytes of each sentence that has a known word."""
        out, at = [], 0
        for s in raw.translate(_TABLE).split(b"\n"):
            known = {w for w in s.split() if w in self.weights}  # a word counts once in a sentence, as in the fit
            if known:
                out.append((at, at + len(s), float(1 / (1 + np.exp(-self.bias - sum(self.weights[w] for w in sorted(known)))))))
            at += len(s) + 1
        return out

    def judge(self, raw: bytes) -> tuple[float, tuple[int, int, float] | None]:
        """The document's score, and its worst sentence (the first of several), if any has a known word."""
        left, found = 1 - self.leak, self.sentences(raw)
        for _, _, p in found:
            left *= 1 - p
        return 1 - left, max(found, key=lambda x: (x[2], -x[0]), default=None)

    def score(self, raw: bytes) -> float:
        return self.judge(raw)[0]


def _vocabulary(raws: list[bytes], y: np.ndarray) -> list[bytes]:
    """Words whose document frequency among toxic documents is above its expectation by over three deviations."""
    of: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
    for raw, label in zip(raws, y, strict=True):
        of[int(label)].update(set(raw.translate(_TABLE).split()))
    share, found = y.mean(), []
    for w, n in of[1].items():
        total = n + of[0][w]
        z = (n - total * share) / np.sqrt(total * share * (1 - share) + 1e-9)
        if total >= LEAST_DOCS and z > 3:
            found.append((-z, w))
    return [w for _, w in sorted(found)[:VOCABULARY]]


def loss_and_gradient(theta: np.ndarray, word: np.ndarray, sentence: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean weighted negative log-likelihood with the weights' penalty, and its gradient. ``theta``: weights, bias, logit of the
    leak; ``word`` and ``sentence``: a row for each known word of a sentence; ``doc``: each sentence's document."""
    w, b, leak = theta[:-2], theta[-2], 1 / (1 + np.exp(-theta[-1]))
    z = b + np.bincount(sentence, w[word], len(doc))
    log_left = np.log1p(-leak) - np.bincount(doc, np.logaddexp(0, z), len(y))
    left = np.exp(log_left)
    loss = (-(1 - y) * log_left - TOXIC_WEIGHT * y * np.log(np.maximum(1 - left, 1e-9))).sum() + 0.025 * (w**2).sum()
    pull = (1 - y) - TOXIC_WEIGHT * y * left / np.maximum(1 - left, 1e-9)  # of each document on all its sentences
    dz = pull[doc] / (1 + np.exp(-z))
    grad = np.concatenate((np.bincount(word, dz[sentence], len(w)) + 0.05 * w, [dz.sum(), leak * pull.sum()]))
    return loss / len(y), grad / len(y)


def fit(raws: list[bytes], labels: list[int]) -> Model:
    """Noisy-or logistic weights from texts and their labels."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model()
    words = _vocabulary(raws, y)
    if not words:
        return Model()
    number = {w: i for i, w in enumerate(words)}
    word, sentence, doc = [], [], []
    for d, raw in enumerate(raws):
        for s in raw.translate(_TABLE).split(b"\n"):
            known = {number[w] for w in s.split() if w in number}
            if known:
                word += sorted(known)
                sentence += [len(doc)] * len(known)
                doc.append(d)
    rows = [np.array(x, np.int64) for x in (word, sentence, doc)]
    theta = np.concatenate((np.full(len(words), 2.0), [-3.0, -3.0]))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        grad = loss_and_gradient(theta, *rows, y)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({w: float(x) for w, x in zip(words, theta, strict=False)}, float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> Model:
    """Fit on the sampled labelled rows of ``docs`` (doc_id, text)."""
    known = sample(labels, label, learn)
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    # bounded by the sample's rows; each id's texts, if it has several, are taken once each
    sizes = sorted((r.h, r.doc_id, r.n) for r in here.select("doc_id", F.xxhash64("doc_id").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect())
    held = np.cumsum([n for _, _, n in sizes])
    if len(sizes) and held[-1] > SAMPLE_BYTES:
        last = sizes[int(np.searchsorted(held, SAMPLE_BYTES))][0]
        here = here.where(F.xxhash64("doc_id") < last)
    rows = here.select("doc_id", F.col("text").cast("binary").alias("text"), "y").toArrow().sort_by("doc_id")
    return fit([x or b"" for x in rows["text"].to_pylist()], rows["y"].to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, worst_start, worst_end, worst_score) of each row: the document's score, and its worst sentence in UTF-8
    bytes with its own score; nulls without a known word."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            judged = [shipped.value.judge(raw) for raw in raw_texts(batch.column("text"))]
            worst = [w or (None, None, None) for _, w in judged]
            yield pa.record_batch([
                batch.column("doc_id"), pa.array([s for s, _ in judged], pa.float64()), *(pa.array([w[i] for w in worst], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))),
            ], names=["doc_id", "score", "worst_start", "worst_end", "worst_score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, worst_start long, worst_end long, worst_score double")


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Offending sentences: doc_id, start and end in UTF-8 bytes, the sentence's text and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [
                {"doc_id": doc, "start": a, "end": b, "sentence": raw[a:b].decode("utf-8", "replace"), "score": float(p)}
                for doc, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True)
                for a, b, p in shipped.value.sentences(raw)
                if p >= least
            ]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, end long, sentence string, score double")


def report(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, cut: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and the worst sentence. Labels of the held-out fold are not learned from."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, remainder(F.col("doc_id"), folds) != fold)
    held = F.coalesce(remainder(F.col("doc_id"), folds) == fold, F.lit(True))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")


def remove_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """The documents whose score is below ``cut``, learned from all labels; columns stay as they are."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, F.lit(True)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array([shipped.value.score(raw) < cut for raw in raw_texts(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
