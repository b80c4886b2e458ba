"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on hashed words learns from documents confirmed toxic and from unlabelled
ones. The risk is prior * risk of positives as positive + max(0, risk of unlabelled as negative
- prior * risk of positives as negative); where the bracket turns negative its gradient is
followed backwards, so that the classifier can't overfit the positives among the unlabelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import held_out, keep_rows, slices, texts
from veilframe.llm.hashing import NON_WORDS, word_hashes

BITS = 20
#: The largest (expected) numbers of confirmed and of unlabelled documents that are learned from.
POSITIVES, UNLABELLED = 4000, 8000
THRESHOLD = 0.3
#: A word's bucket is a feature if its number of confirmed documents is so many standard deviations from what its share of the
#: unlabelled ones makes expected, and above it only with LEAST_DOCS of them.
LEAST_Z, LEAST_DOCS = 5.0, 4
#: A share of toxic documents of nothing or of all counts as so far from it, so that its logarithm is finite.
LEAST_PRIOR = 1e-4
STEPS, RATE, DECAY = 300, 0.05, 2e-5


def features(text: str) -> np.ndarray:
    """Sorted distinct buckets of the text's words; ASCII letters count in either case."""
    return np.unique(word_hashes(text, NON_WORDS) >> np.uint64(64 - BITS)).astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Sparse:
    """Rows of column numbers with value 1."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.columns = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(rows)), self.sizes)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.columns], len(self.sizes))

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.columns, g[self.owner], n)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> float:
        return float(_sigmoid(np.float64(self.weights[features(text)].sum(dtype=np.float64) + self.bias)))


def _distinct(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Without most near copies of an earlier row: those with its least buckets under four orders. Else a copied text's words pass for signs of its label."""
    found: dict[tuple[int, ...], np.ndarray] = {}
    for row in rows:
        found.setdefault(tuple(int((row.astype(np.uint32) * np.uint32(m)).min()) for m in (2654435761, 2246822519, 3266489917, 668265263)) if len(row) else (), row)
    return list(found.values())


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Minimises the non-negative risk with the logistic loss by full-batch Adam."""
    weights = np.zeros(1 << BITS, np.float32)
    prior = min(max(prior, LEAST_PRIOR), 1 - LEAST_PRIOR)
    if not positive or not unlabelled:
        return Model(weights, float(np.log(prior / (1 - prior))))
    positive, unlabelled = _distinct(positive), _distinct(unlabelled)
    in_p, in_u = (np.bincount(np.concatenate(rows), minlength=1 << BITS) for rows in (positive, unlabelled))
    expected = (in_u + 1) * (len(positive) / (len(unlabelled) + 1))
    apart = np.abs(in_p - expected) >= LEAST_Z * np.sqrt(expected)
    kept = np.flatnonzero(apart & ((in_p < expected) | (in_p >= min(LEAST_DOCS, len(positive)))))
    number = np.full(1 << BITS, -1, np.int64)
    number[kept] = np.arange(len(kept))
    p, u = (Sparse([(c := number[r])[c >= 0] for r in rows]) for rows in (positive, unlabelled))
    n = len(kept)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        at_p, at_u = _sigmoid(p.times(w) + w[n]), _sigmoid(u.times(w) + w[n])
        # the logistic loss: -log s as positive, -log(1 - s) as negative
        as_negative = -np.log1p(-np.minimum(at_u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(at_p, 1 - 1e-12)).mean()
        if as_negative >= 0:
            g_p, g_u = prior * (at_p - 1) - prior * at_p, at_u
        else:
            g_p, g_u = prior * at_p, -at_u
        g_p, g_u = g_p / len(at_p), g_u / len(at_u)
        grad = np.append(p.back(g_p, n) + u.back(g_u, n) + DECAY * w[:n], g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights[kept] = w[:n]
    # the mean posterior of the unlabelled is the prior; where correction ran backwards it is too high
    evidence, low, high = u.times(w), -30.0, 30.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(evidence + middle).mean() < prior else (low, middle)
    return Model(weights, min(float(w[n]), low))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = [features(t).tobytes() for t in texts(part.column("text"))]
        yield pa.RecordBatch.from_arrays([part.column("known"), pa.array(found, pa.binary())], ["known", "features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learns from a bounded sample of the documents that aren't held out.

    Confirmed: rows of labels with label 1. Unlabelled: any documents, whatever their label, chosen by
    a hash of the id. prior: the share of toxic documents; by default that among all labelled ones
    that aren't held out (no less than LEAST_PRIOR, no more than 1 - LEAST_PRIOR). Without confirmed documents every text scores the prior. Most near copies in
    the sample count once (see _distinct), so that a text copied often doesn't teach its words as signs.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    total, toxic = known.agg(F.count(F.lit(1)), F.sum((F.col("label") == 1).cast("int"))).first()
    rows = docs.filter(~held_out(F.col(id_col)) & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    count = rows.count()
    at = F.pmod(F.xxhash64("id", F.lit("pu")), F.lit(1_000_003)) / 1_000_003.0
    confirmed = known.filter(F.col("label") == 1).filter(at < min(1.0, positives / max(toxic or 0, 1))).select("id", F.lit(True).alias("known"))  # about `positives` rows at most, so broadcast
    at_random = F.pmod(F.xxhash64("id", F.lit("all")), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.join(F.broadcast(confirmed), "id", "left").withColumn("other", at_random < min(1.0, unlabelled / max(count, 1)))
    sample = sample.filter(F.col("known") | F.col("other"))
    # a confirmed document that is in the unlabelled sample too counts in both
    sides = sample.withColumn("known", F.explode(F.array_compact(F.array(F.when(F.col("known"), F.lit(True)), F.when(F.col("other"), F.lit(False))))))
    found = sides.select("known", "text").mapInArrow(_features, "known boolean, features binary").collect()  # bounded by the two sizes
    side = lambda known: [np.frombuffer(r["features"], np.int32) for r in found if r["known"] == known]
    return fit(side(True), side(False), (toxic or 0) / total if prior is None and total else prior or 0.01)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0) of every row.

    Null and empty texts score as texts without words. Repeated rows give repeated results; empty
    tables none. Only the text decides a score.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for part in slices(batches):
            found = np.array([own.score(t) for t in texts(part.column("text"))])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def keep(batch: pa.RecordBatch) -> list[bool]:
        own = Model(*shared.value)
        return [own.score(t) < threshold for t in texts(batch.column(0))]

    return keep_rows(docs, [text_col], keep)
