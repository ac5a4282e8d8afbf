"""Quality from a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Each byte has two learned embeddings, which add up: of itself, and of how far
back, up to LAGS bytes, the four bytes that begin with it stood before, so that
filters see repetition whatever is repeated. Learned filters run over the
embedded bytes and are max-pooled; a
hidden layer turns a chunk's maxima and its fill into log-odds of being bad, and
the document's are the soft average, log(mean(exp(.))), of its chunks'. The
network is trained by Adam on at most SAMPLE labelled texts of each label
(documented bound); a fifth of them sets the calibration, and the shares of the
labels among all labelled rows correct for the sample's.

Cases: null and empty texts are one chunk without bytes; repeated rows are
scored row by row; without labels of both kinds every score is the share of
label 1 (1 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .subwords import labelled_sample, map_texts
from .toxicity import _calibrate

SAMPLE = 1500
SEED = 5
CHUNK = 768
OVERLAP = 64
TAPS = 8
#: CHUNK - TAPS is a multiple of it, so that a chunk's last byte is under a filter too.
STRIDE = 2
#: Bytes back that a recurrence is looked for, and how many of those share an embedding.
LAGS = 32
LAG_STEP = 4
EMBEDDING = 8
FILTERS = 32
HIDDEN = 16
BATCH = 48
STEPS = 500
RATE = 0.01
THRESHOLD = 0.3
#: Chunks that are convolved at once.
AT_ONCE = 64


def chunks(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of each chunk padded with zeros, length of each chunk, its text). Chunks of a text overlap and cover it."""
    rows, lengths, of = [], [], []
    for k, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        for start in range(0, max(len(raw) - OVERLAP, 1), CHUNK - OVERLAP):
            part = raw[start : start + CHUNK]
            rows.append(np.pad(part, (0, CHUNK - len(part))) if len(part) < CHUNK else part)
            lengths.append(len(part))
            of.append(k)
    return np.stack(rows) if rows else np.zeros((0, CHUNK), np.uint8), np.array(lengths, np.int64), np.array(of, np.int64)


def inputs(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each byte plus 256 times the class of its recurrence: 0 for none, else 1 for the nearest LAG_STEP places and so on."""
    out = x.astype(np.uint16)
    four = x[:, :-3].astype(np.uint32)
    for k in (1, 2, 3):
        four |= x[:, k : x.shape[1] - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    kind = np.zeros(x.shape, np.uint16)
    for lag in range(LAGS, 0, -1):
        np.copyto(kind[:, lag:-3], np.uint16((lag - 1) // LAG_STEP + 1), where=four[:, lag:] == four[:, :-lag])
    kind[np.arange(x.shape[1]) + 3 >= lengths[:, None]] = 0
    return out + (kind << np.uint16(8))


def _patches(weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The filters' inputs: chunks x positions x (TAPS * EMBEDDING)."""
    both = (weights[7][:, None] + weights[0][None]).reshape(-1, EMBEDDING)
    e = both.take(x, axis=0).reshape(len(x), CHUNK * EMBEDDING)
    n = (CHUNK - TAPS) // STRIDE + 1
    s = e.strides
    return np.lib.stride_tricks.as_strided(e, (len(x), n, TAPS * EMBEDDING), (s[0], STRIDE * EMBEDDING * s[1], s[1]))


def _pooled(weights: list[np.ndarray], x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of each filter over each chunk, not below zero, and where it is."""
    p = _patches(weights, x)
    r = (p.reshape(-1, TAPS * EMBEDDING) @ weights[1]).reshape(len(x), p.shape[1], FILTERS) + weights[2]
    past = np.arange(p.shape[1])[None, :] * STRIDE >= np.maximum(lengths, 1)[:, None]
    r[past] = -1.0
    where = r.argmax(axis=1)
    return np.maximum(np.take_along_axis(r, where[:, None, :], axis=1)[:, 0], 0), where


def _soft_mean(z: np.ndarray, of: np.ndarray, n: int, none: float) -> tuple[np.ndarray, np.ndarray]:
    """log(mean(exp(z))) of each text, and each window's share of it."""
    out = np.full(n, none)
    if not len(z):
        return out, np.zeros(0)
    at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    size = np.diff(np.concatenate((at, [len(of)])))
    top = np.maximum.reduceat(z, at)
    e = np.exp(z - np.repeat(top, size))
    total = np.add.reduceat(e, at)
    out[of[at]] = top + np.log(total / size)
    return out, e / np.repeat(total, size)


@dataclass
class Model:
    """weights: bytes' embeddings, filters, their biases, hidden layer and its biases, output and its bias, recurrences' embeddings."""

    weights: list[np.ndarray]
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Log-odds of being bad."""
        x, lengths, of = chunks(texts)
        w = self.weights
        out = []
        for k in range(0, len(x), AT_ONCE):
            some, fill = x[k : k + AT_ONCE], lengths[k : k + AT_ONCE]
            top, _ = _pooled(w, inputs(some, fill), fill)
            v = np.concatenate((top, (fill / CHUNK)[:, None]), axis=1)
            out.append(np.maximum(v @ w[3] + w[4], 0) @ w[5] + w[6])
        z = np.concatenate(out).astype(np.float64) if out else np.zeros(0)
        return _soft_mean(z, of, len(texts), 0.0)[0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.scale * self.raw(texts) + self.shift, -40, 40)))


def train(texts: list[str | None], labels: np.ndarray, good: int, bad: int, seed: int = SEED) -> Model:
    """Fit the network to labels (1: good); good and bad: labelled rows of each kind, sampled or not."""
    rng = np.random.default_rng(seed)
    shape = [(256, EMBEDDING), (TAPS * EMBEDDING, FILTERS), (FILTERS,), (FILTERS + 1, HIDDEN), (HIDDEN,), (HIDDEN,), (1,), (1 + LAGS // LAG_STEP, EMBEDDING)]
    scale = [0.5, (TAPS * EMBEDDING) ** -0.5, 0, (FILTERS + 1) ** -0.5, 0, HIDDEN**-0.5, 0, 0.5]
    w = [(rng.normal(0, 1, s) * k).astype(np.float32) for s, k in zip(shape, scale, strict=True)]
    model = Model(w)
    if not len(texts) or labels.min() == labels.max():
        share = good / (good + bad) if good + bad else 1.0
        return Model(w, 0.0, float(np.log((1 - share + 1e-9) / (share + 1e-9))))
    y = 1.0 - labels
    held = rng.random(len(texts)) < 0.2
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    cut = [(inputs(x, n), n) for x, n, _ in (chunks([t]) for t in texts)]
    kinds = [np.flatnonzero(~held & (y == k)) for k in (0, 1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in w]
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(k, BATCH // 2) for k in kinds])
        x, lengths = np.concatenate([cut[k][0] for k in pick]), np.concatenate([cut[k][1] for k in pick])
        of = np.repeat(np.arange(len(pick)), [len(cut[k][0]) for k in pick])
        tops, places = zip(*(_pooled(w, x[k : k + AT_ONCE], lengths[k : k + AT_ONCE]) for k in range(0, len(x), AT_ONCE)), strict=True)
        v = np.concatenate((np.concatenate(tops), (lengths / CHUNK)[:, None]), axis=1).astype(np.float32)
        place = np.concatenate(places)
        hidden = np.maximum(v @ w[3] + w[4], 0)
        z, share = _soft_mean((hidden @ w[5] + w[6]).astype(np.float64), of, len(pick), 0.0)
        slope = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick])[of] * share / len(pick)).astype(np.float32)
        back = slope[:, None] * w[5] * (hidden > 0)
        down = (back @ w[3].T)[:, :FILTERS] * (v[:, :FILTERS] > 0)
        grads = [np.zeros_like(w[0]), np.zeros_like(w[1]), down.sum(0), v.T @ back, back.sum(0), hidden.T @ slope, np.array([slope.sum()], np.float32), np.zeros_like(w[7])]
        at = place * STRIDE
        seen = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(TAPS)]
        felt = (w[0][seen & 255] + w[7][seen >> 8]).reshape(len(x), FILTERS, TAPS * EMBEDDING)
        grads[1] = np.einsum("nf,nfk->kf", down, felt, optimize=True)
        into = (down[:, :, None] * w[1].T[None]).reshape(-1, EMBEDDING)
        flat = seen.reshape(-1)
        for j in range(EMBEDDING):
            grads[0][:, j] = np.bincount(flat & 255, into[:, j], 256)
            grads[7][:, j] = np.bincount(flat >> 8, into[:, j], len(w[7]))
        for p, g, (m, s) in zip(w, grads, moments, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= RATE * (1 - 0.8 * step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    some = held if held.any() else np.ones(len(y), bool)
    model.scale, model.shift = _calibrate(model.raw([t for t, h in zip(texts, some, strict=True) if h]), y[some])
    model.shift += float(np.log(bad / good) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, bound: int = SAMPLE) -> Model:
    """labels(doc_id, label 0/1): fit to a bounded sample of those where learn holds."""
    rows = labelled_sample(docs, labels, learn, SEED, bound).toPandas().sort_values("doc_id")
    bad, good = labels.where(learn).agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    return train(rows["text"].tolist(), rows["label"].to_numpy(np.int64), good, bad)


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for each row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], lambda texts: {"score": shared.value.score(texts)}, "doc_id long, score double", 1 << 18)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    side = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit(docs, labels.select("doc_id", F.col("quality").alias("label")), side != 0)
    return quality(docs, model).select("doc_id", (side == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
