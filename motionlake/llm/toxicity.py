"""Toxicity from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a bag of its hashed character n-grams: their embeddings are averaged,
and a softplus of one direction of that tells how much the word speaks for label
1. A text's words are averaged, and a linear softmax of the average gives its
log-odds; every word of the whole text counts, but one that was among the few
before it doesn't count again. An unseen misspelling shares most n-grams with the
word it stands for.

The model is fitted to at most SAMPLE labelled texts of each label (documented
bound), by seeded hash, and to nothing else; a fifth of them sets the
calibration, as if both labels were as frequent, since they are in large samples. Since scoring is linear up to the word, embeddings and direction
fold into one number a bucket, which is what the tasks get.

Cases: null or wordless texts get the score of a text without evidence; repeated
rows are scored row by row; without labels of both kinds every score is the share
of label 1 (0 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .subwords import BUCKETS, Batch, labelled_sample, map_texts

SAMPLE = 2500
SEED = 11
#: Words before a word among which it doesn't count again.
NEAR = 7
#: Bytes of the n-grams, word edges included.
GRAMS = (4, 6)
#: Grams without evidence that every word has besides its learned ones.
UNKNOWN = 2
DIMENSION = 4
EPOCHS = 60
RATE = 0.08
#: Pull of the embeddings towards zero.
DECAY = 0.02
#: Buckets in fewer texts of the sample than this, and than this share of them, stay at zero.
MIN_TEXTS = 3
MIN_SHARE = 0.002
THRESHOLD = 0.7


def _fresh(words: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each word is none of the NEAR before it in its text."""
    fresh = np.ones(len(words), bool)
    for k in range(1, NEAR + 1):
        fresh[k:] &= (words[k:] != words[:-k]) | (of[k:] != of[:-k])
    return fresh


def _means(x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, x, n) / np.maximum(np.bincount(of, minlength=n), 1)


@dataclass
class Model:
    """values: each bucket's part in a word's evidence (a zero row at the end); threshold: what a word without any has; weight and bias of the average; scale and shift of the calibration."""

    values: np.ndarray
    threshold: float
    weight: float
    bias: float
    scale: float
    shift: float

    def raw(self, texts: list[str | None]) -> np.ndarray:
        batch = Batch(texts)
        fresh = _fresh(batch.word_hashes(), batch.of)
        z, c = batch.word_sums(self.values, GRAMS, True)
        evidence = np.logaddexp(0, z[fresh] / (c[fresh] + UNKNOWN) + self.threshold)
        return self.weight * _means(evidence, batch.of[fresh], batch.n) + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(texts) + self.shift, -40, 40)))


def _vocabulary(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of each word of the batch among the distinct words; and of the distinct words' grams the bucket and the word, with the grams of each."""
    ends = np.minimum(np.concatenate((batch.words[1:], [len(batch.buf)])) - 1, len(batch.buf) - 1)
    raw = batch.buf.tobytes()
    known: dict[bytes, int] = {}
    tokens = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(batch.words.tolist(), ends.tolist(), strict=True)], np.int32)
    words = Batch([w.decode("utf-8", "surrogatepass") for w in known])
    word_of = np.zeros(len(words.buf), np.int32)
    word_of[np.maximum(words.words - 1, 0)[1:]] = 1
    word_of = np.cumsum(word_of, dtype=np.int32)
    ids, owner = [], []
    for first, g in words.grams(BUCKETS, GRAMS):
        ok = g < BUCKETS
        ids.append(g[ok])
        owner.append(word_of[first : first + len(g)][ok])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    return tokens, ids, owner, np.bincount(owner, minlength=len(known)).astype(np.float32)


def train(texts: list[str | None], labels: np.ndarray, seed: int = SEED) -> Model:
    """Fit embeddings, direction, softmax and calibration."""
    values = np.zeros(BUCKETS + 1, np.float32)
    if not len(texts) or labels.min() == labels.max():
        share = float(labels.mean()) if len(texts) else 0.0
        return Model(values, 0.0, 0.0, 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < 0.2
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    batch = Batch([t for t, h in zip(texts, held, strict=True) if not h])
    y = labels[~held].astype(np.float64)
    tokens, ids, owner, count = _vocabulary(batch)
    # texts that have a bucket: by distinct (text, word), then through the words' grams
    pairs = np.unique(batch.of * len(count) + tokens)
    word_texts = np.bincount(pairs % len(count), minlength=len(count))
    seen = np.bincount(ids, word_texts[owner], BUCKETS)
    used = np.flatnonzero(seen >= max(MIN_TEXTS, MIN_SHARE * batch.n))
    slot = np.full(BUCKETS, -1, np.int32)
    slot[used] = np.arange(len(used))
    ok = slot[ids] >= 0
    # in the order of words, as the sums run; whole numbers as numpy indexes with
    ids, owner = slot[ids[ok]], owner[ok]
    ids, owner = ids[np.argsort(owner, kind="stable")].astype(np.intp), np.sort(owner, kind="stable")
    with_grams, at = np.unique(owner, return_index=True)
    owner = owner.astype(np.intp)
    fresh = _fresh(tokens, batch.of)
    tokens, of = tokens[fresh].astype(np.intp), batch.of[fresh].astype(np.intp)
    n_words = np.maximum(np.bincount(of, minlength=batch.n), 1)
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    share /= share.sum()
    e, params = rng.normal(0, 0.01, (len(used), DIMENSION)), [rng.normal(0, 1.0, DIMENSION), np.array([-3.0]), np.array([20.0]), np.array([-2.0])]
    params.insert(0, e)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    size = np.bincount(owner, minlength=len(count)) + UNKNOWN
    for step in range(1, EPOCHS + 1):
        e, a, threshold, weight, bias = params
        z = np.zeros(len(count))
        z[with_grams] = np.add.reduceat((e @ a)[ids], at) if len(at) else 0.0
        z = z / size + threshold
        word = np.logaddexp(0, z)
        mean = np.bincount(of, word[tokens], batch.n) / n_words
        slope = share * (1 / (1 + np.exp(-np.clip(weight * mean + bias, -40, 40))) - y)
        per_word = np.bincount(tokens, (slope / n_words)[of], len(count)) * weight / (1 + np.exp(-z))
        per_bucket = np.bincount(ids, (per_word / size)[owner], len(used))
        grads = [np.outer(per_bucket, a) + DECAY / len(used) * e, e.T @ per_bucket, per_word.sum(keepdims=True), np.array([(slope * mean).sum()]), slope.sum(keepdims=True)]
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    values[used] = params[0] @ params[1]
    model = Model(values, *(float(p[0]) for p in params[2:]), 1.0, 0.0)
    model.scale, model.shift = _calibrate(model.raw([t for t, h in zip(texts, held, strict=True) if h or not held.any()]), labels[held] if held.any() else labels, True)
    return model


def _calibrate(x: np.ndarray, y: np.ndarray, even: bool = False) -> tuple[float, float]:
    """Logistic fit of y to x by Newton steps, with smoothed targets so that a clean split stays finite. even: as if both labels were as frequent."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    each = np.where(y == 1, len(y) / 2 / n1, len(y) / 2 / n0) if even else np.ones(len(y))
    w = np.zeros(2)
    f = np.stack((x, np.ones(len(x))), axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -40, 40)))
        h = f.T @ (f * (each * p * (1 - p))[:, None]) + 1e-4 * np.eye(2)
        w = w - np.linalg.solve(h, f.T @ (each * (p - goal)) + 1e-4 * w)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, bound: int = SAMPLE) -> Model:
    """labels(doc_id, label 0/1): fit to a bounded sample of those where learn holds."""
    rows = labelled_sample(docs, labels, learn, SEED, bound).toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), rows["label"].to_numpy(np.int64))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for each row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], lambda texts: {"score": shared.value.score(texts)}, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    side = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(docs, labels.select("doc_id", F.col("toxic").alias("label")), side != 1)
    out = toxicity(docs, model)
    return out.select("doc_id", (side == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
