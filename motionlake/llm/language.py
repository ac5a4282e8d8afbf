"""Language identification from averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed character n-grams (two to
four bytes, word edges included); a linear softmax names the language.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy on at most SAMPLE labelled texts of each language (documented bound). A
fifth of them, held back, sets a temperature, so that scores are probabilities,
and the score below which a prediction is rejected.

Cases: a null text or one without a letter is `und` with score 0; repeated rows
are predicted row by row; a single learned language is always predicted;
without labels everything is `und`; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .subwords import Batch, labelled_sample, map_texts

SAMPLE = 400
SEED = 7
BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
DIMENSION = 16
EPOCHS = 5
RATE = 0.5
#: Share of right answers that accepted predictions shall have at least, on the held-back texts.
PRECISION = 0.99
UNKNOWN = "und"


@dataclass
class Model:
    """values: log-odds of each bucket for each language (a zero row at the end); sharpness: 1 / temperature; reject: scores below are doubtful."""

    languages: list[str]
    values: np.ndarray
    bias: np.ndarray
    sharpness: float
    reject: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        batch = Batch(texts)
        total, count = np.zeros((batch.n, len(self.languages))), np.zeros(batch.n)
        at = np.maximum(batch.starts - 1, 0)
        for first, ids in batch.grams(BUCKETS, GRAMS):
            ok = ids < BUCKETS
            where = np.flatnonzero(ok) + first
            of = np.searchsorted(at, where, side="right") - 1
            rows = self.values[ids[ok]]
            if len(of):
                new = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                total[of[new]] += np.add.reduceat(rows, new)
                count += np.bincount(of, minlength=batch.n)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        spoken = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.languages:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts)), "doubtful": np.ones(len(texts), bool)}
        p = _softmax(self.logits(texts) * self.sharpness)
        best = p.argmax(axis=1)
        score = np.where(spoken, p[np.arange(len(texts)), best], 0.0)
        return {"lang_pred": [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), spoken.tolist(), strict=True)], "score": score, "doubtful": score < self.reject}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str | None], labels: list[str], seed: int = SEED) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(v) for v in labels])
    held = rng.random(len(texts)) < 0.2
    held &= len(texts) >= 10
    e = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSION)) / DIMENSION
    w, bias = np.zeros((DIMENSION, len(languages))), np.zeros(len(languages))
    bags = []
    for k in np.flatnonzero(~held).tolist():
        ids = np.concatenate([g[g < BUCKETS] for _, g in Batch([texts[k]]).grams(BUCKETS, GRAMS)])
        u, c = np.unique(ids, return_counts=True)
        if len(u):
            bags.append((u, c / c.sum(), y[k]))
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)).tolist():
            u, c, label = bags[k]
            rate = RATE * (1 - done / steps)
            h = c @ e[u]
            z = h @ w + bias
            slope = np.exp(z - z.max())
            slope /= slope.sum()
            slope[label] -= 1
            back = w @ slope
            w -= rate * np.outer(h, slope)
            bias -= rate * 0.01 * slope
            # a bag's gradient is spread over its buckets; scale it up so that single buckets learn
            e[u] -= rate * 100 * np.outer(c, back)
            done += 1
    model = Model(languages, np.concatenate((e @ w, np.zeros((1, len(languages))))).astype(np.float32), bias, 1.0, 0.0)
    if held.any():
        z, goal = model.logits([texts[k] for k in np.flatnonzero(held)]), y[held]
        grid = np.geomspace(0.1, 20, 60)
        loss = [-np.log(_softmax(z * s)[np.arange(len(goal)), goal] + 1e-12).mean() for s in grid]
        model.sharpness = float(grid[int(np.argmin(loss))])
        p = _softmax(z * model.sharpness)
        right, score = p.argmax(axis=1) == goal, p.max(axis=1)
        order = np.argsort(-score)
        precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
        model.reject = float(score[order[np.flatnonzero(precise)[-1]]]) if precise.any() else 1.0
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, bound: int = SAMPLE) -> Model:
    """labels(doc_id, label string): fit to a bounded sample of those where learn holds."""
    rows = labelled_sample(docs, labels, learn, SEED, bound).toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), rows["label"].tolist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and doubtful (rejected at the calibrated score) for each row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], lambda texts: shared.value.predict(texts), "doc_id long, lang_pred string, score double, doubtful boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    side = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs, docs.select("doc_id", F.col("lang").alias("label")), side != 2)
    return identify(docs, model).select("doc_id", (side == 2).alias("held_out"), "lang_pred", "score", "doubtful")
