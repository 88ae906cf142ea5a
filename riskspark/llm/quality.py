"""Quality classifier: supervised subword embeddings.

A text is a bag of hashed features: its white-space separated words, the byte 3- and 4-grams of
each word between word marks, and one feature for a word that repeats its predecessor. Every feature
has a learned vector; the text's vector is the mean over all its features and a softmax layer
follows. Both are trained together by stochastic gradient descent in numpy, with dense updates of the
features a minibatch touches.

Training uses at most ``TRAIN_ROWS`` label rows, the ones with the smallest hash of their id, in one
task (the one documented bound here). Scoring reads every whole text in one narrow pass. As the
layers are linear, a feature's share in the logit is one number, which is summed per distinct word.

Defined cases: NULL text and a text without words have no features and get the bias alone; without
labels of both classes, every score is the share of label 1 (0.5 without labels). Very long texts enter whole; repeated
rows are scored one by one, and repeated labels of an id count as often as they stand there; equal draws of the
sample are ordered by id and label; rows without an id teach nothing but are scored; an empty table gives no rows.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import groups_of, map_rows, pa_schema, worker_state

TRAIN_ROWS = 4_000
BUCKETS = 1 << 17
DIMENSIONS = 16
EPOCHS, MINIBATCH, RATE = 4, 32, 4.0
FEWEST_STEPS = 600  # small samples take more epochs
GRAMS = (3, 4)
REPEATED = BUCKETS  # the feature of a word that repeats its predecessor
MEMO_WORDS = 1 << 18
CHARS_AT_ONCE = 1 << 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of some words, by kind: (features, positions of their words, ascending)."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw)))
    kinds = [(np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % BUCKETS, np.arange(len(raw)))]
    for n in GRAMS:
        count = max(0, len(data) - n + 1)
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h = (h ^ data[k : count + k]) * MIX
        inside = owner[n - 1 :] == owner[:count] if count else np.zeros(0, bool)
        kinds.append(((h[inside] >> np.uint64(40)).astype(np.int64) % BUCKETS, owner[:count][inside]))
    return kinds


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a whole text and their shares among all its features."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct, at = np.unique(np.array(words, object), return_inverse=True)
    times = np.bincount(at)
    repeats = sum(map(operator.eq, words, words[1:]))
    kinds = word_features(distinct.tolist())
    ids = np.concatenate([f for f, _ in kinds] + [[REPEATED]])
    counts = np.concatenate([times[w] for _, w in kinds] + [[repeats]])
    used, at = np.unique(ids, return_inverse=True)
    return used, np.bincount(at, counts) / counts.sum()


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Log-odds of label 1 that each feature adds per unit of share, and the bias."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1e-3) / (len(y) + 2e-3)
        return np.zeros(BUCKETS + 1), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS + 1, DIMENSIONS))
    output, bias = np.zeros((DIMENSIONS, 2)), np.log(np.bincount(y, minlength=2) / len(y))
    features = [text_features(t) for t in texts]
    each = -(-len(y) // MINIBATCH)
    epochs = max(EPOCHS, -(-FEWEST_STEPS // each))
    steps, step = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), MINIBATCH):
            rows = [r for r in order[a : a + MINIBATCH].tolist() if len(features[r][0])]
            if not rows:
                continue
            rate = RATE * (1 - step / steps)
            step += 1
            ids = np.concatenate([features[r][0] for r in rows])
            shares = np.concatenate([features[r][1] for r in rows])
            starts = np.cumsum([0] + [len(features[r][0]) for r in rows[:-1]])
            means = np.add.reduceat(vectors[ids] * shares[:, None], starts)
            logits = means @ output + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ output.T
            output -= rate * means.T @ p
            bias -= rate * p.sum(axis=0) * 0.1
            owner = np.repeat(np.arange(len(rows)), np.diff(np.r_[starts, len(ids)]))
            order_ids = np.argsort(ids, kind="stable")
            touched, first = np.unique(ids[order_ids], return_index=True)
            gradient = shares[order_ids, None] * back[owner[order_ids]]
            vectors[touched] -= rate * len(rows) * np.add.reduceat(gradient, first)
    return vectors @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0])


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, float]:
    """Fit on the ``TRAIN_ROWS`` label rows with the smallest hash of their id (all, if fewer)."""
    spark = docs.sparkSession
    draw = F.xxhash64("id")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    sample = known.orderBy(draw, "id", "label").limit(TRAIN_ROWS)
    # the sample is bounded: it may be broadcast, and one task holds its texts
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(sample), "id").repartition(1).sortWithinPartitions(draw, "id", "label", "text")
    schema = pa_schema(spark, "weights binary, bias double")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality training", dict)
        texts, labels = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            labels += b.column("label").to_pylist()
        weights, bias = train(texts, labels)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()]), pa.array([bias])], schema=schema)

    got = sample.select("text", "label").mapInArrow(fit, "weights binary, bias double").collect()
    if not got:
        return train([], [])
    return np.frombuffer(got[0]["weights"], "<f4").astype(float), got[0]["bias"]


class Scorer:
    """Scores texts; remembers (sum of weights, number of features) per distinct word."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.memo: dict[str, complex] = {}  # real: sum of weights, imaginary: number of features

    def scores(self, texts: list[str | None]) -> list[float]:
        groups = groups_of(texts, len(texts), CHARS_AT_ONCE)
        return [score for i, j in groups for score in self._scores(texts[i:j])]

    def _scores(self, texts: list[str | None]) -> list[float]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        known = self.memo.get
        split = [(t or "").split() for t in texts]
        values = [list(map(known, words)) for words in split]
        lacking = [i for i, v in enumerate(values) if None in v]
        new = list({w for i in lacking for w, v in zip(split[i], values[i]) if v is None})
        if new:
            sums, sizes = np.zeros(len(new)), np.zeros(len(new))
            for ids, owner in word_features(new):
                sums += np.bincount(owner, self.weights[ids], len(new))
                sizes += np.bincount(owner, minlength=len(new))
            self.memo.update(zip(new, (sums + 1j * sizes).tolist()))
            for i in lacking:
                values[i] = map(self.memo.__getitem__, split[i])
        out = []
        for words, shares in zip(split, values):
            total = sum(shares)
            repeats = sum(map(operator.eq, words, words[1:]))
            n = total.imag + repeats
            logit = self.bias + ((total.real + repeats * self.weights[REPEATED]) / n if n else 0)
            out.append(float(1 / (1 + np.exp(-np.clip(logit, -500, 500)))))
        return out


def scorer(model: tuple[np.ndarray, float]) -> Scorer:
    """The worker's scorer for a model."""
    weights, bias = model
    return worker_state(f"quality {zlib.crc32(weights.tobytes())} {bias}", lambda: Scorer(weights, bias))


def predict(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every text; no other column is read."""

    def batch(cols: dict[str, list]) -> dict[str, list]:
        return {"id": cols["id"], "score": scorer(model).scores(cols["text"])}

    kind = docs.schema[id_col].dataType.simpleString()
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(pairs, batch, f"id {kind}, score double").withColumnRenamed("id", id_col)
