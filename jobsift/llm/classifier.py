"""Quality classifier: Naive Bayes support vectors (NBSVM).

Features are indicators of word 1- and 2-grams and of word-shape 1- to
3-grams (letters and digits by class, other signs as they are, a repeated
word as ``=``), hashed to ``DIMS`` buckets, with the text's length class.
``train`` counts every bucket's documents per class over *all* training rows
(partial counts per batch, summed by Spark), scales the indicators by the
log-count ratios, and fits a linear hinge-loss model by dual coordinate
descent on at most ``MAX_FIT`` training rows chosen by hash; a fifth of
those rows calibrates margins to probabilities.  ``score`` maps whole texts.

Defined cases: null and empty texts have the length class alone and still get
a score; repeated label rows of a document count once (quality: the lower);
null labels and ids are no training rows; labels of one class only (or none)
give every document the smoothed share of label 1; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.common import broadcast_if_small

DIMS = 1 << 18
MAX_FIT = 6000   # rows the margin is fitted on; the ratios come from all
EPOCHS = 12
COST = 1.0

_SHAPE = bytes.maketrans(bytes(range(256)), bytes(
    0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c
    for c in range(256)))
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def word_shape(word: bytes) -> bytes:
    """Runs of one class collapsed: b'Das,!!' -> b'Aa,!'."""
    s = word.translate(_SHAPE)
    return bytes(c for i, c in enumerate(s) if not i or s[i - 1] != c)


class Features:
    """Feature buckets of a text; caches the hashes of words it has seen."""

    def __init__(self, limit: int = 500_000):
        self.cache: dict[bytes, tuple[int, int]] = {}
        self.limit = limit

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > self.limit:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = (xxhash.xxh3_64_intdigest(w), xxhash.xxh3_64_intdigest(word_shape(w), seed=1))
        return np.array([cache[w] for w in words], np.uint64).reshape(-1, 2)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().split()
        length = np.array([len(words).bit_length() + 1], np.uint64) * _M3
        if not words:
            return (length >> np.uint64(46)).astype(np.int32)
        h = self._hashes(words)
        w, s = h[:, 0], h[:, 1].copy()
        s[1:][w[1:] == w[:-1]] = np.uint64(0x3D)  # '=': the word before, again
        grams = [w, s, w[:-1] * _M1 + w[1:], s[:-1] * _M2 + s[1:], (s[:-2] * _M1 + s[1:-1]) * _M2 + s[2:]]
        keys = np.concatenate([*[(g ^ np.uint64(i)) * _M3 for i, g in enumerate(grams)], length])
        return np.unique(((keys ^ (keys >> np.uint64(32))) * _M1) >> np.uint64(46)).astype(np.int32)


@dataclass
class Model:
    ratio: np.ndarray   # log-count ratios by bucket
    weight: np.ndarray  # of the scaled indicators; the last entry is the bias
    slope: float
    offset: float

    def margin(self, idx: np.ndarray) -> float:
        x = self.ratio[idx]
        norm = np.sqrt((x * x).sum()) or 1.0
        return float((self.weight[idx] * x).sum() / norm + self.weight[-1])

    def probability(self, margin) -> np.ndarray:
        z = np.clip(self.slope * np.asarray(margin, float) + self.offset, -30, 30)
        return 1.0 / (1.0 + np.exp(-z))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, cost: np.ndarray,
                            epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """min |w|^2/2 + sum cost_i * hinge_i, over rows of (indices, values); a bias is the last weight."""
    w, alpha = np.zeros(dims + 1), np.zeros(len(rows))
    square = np.array([(v * v).sum() + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            idx, v = rows[i]
            grad = y[i] * ((w[idx] * v).sum() + w[-1]) - 1.0
            new = min(max(alpha[i] - grad / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[idx] += step * v
                w[-1] += step
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic calibration by Newton steps, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones_like(margins)])
    beta = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        grad = x @ (p - t) + 1e-3 * beta
        hess = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(hess, grad)
    return float(beta[0]), float(beta[1])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, counts = Features(), np.zeros((2, DIMS), np.int64)
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            counts[label][features(text)] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])],
                                     names=["bucket", "n0", "n1"])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column("h"), b.column("label"),
             pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))],
            names=["h", "label", "idx"])


def train(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """docs(doc_id, text), labels(doc_id, label 0/1) -> model."""
    rows = (labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id")
            .agg(F.min("label").cast("int").alias("label")))
    n = rows.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in n}
    share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    flat = Model(np.zeros(DIMS), np.zeros(DIMS + 1), 0.0, float(np.log(share / (1 - share))))
    if len(n) < 2:
        return flat
    labelled = docs.select("doc_id", "text").join(broadcast_if_small(rows, sum(n.values()), 32), "doc_id")
    counts = (labelled.select("text", "label").mapInArrow(_count_batches, "bucket int, n0 long, n1 long")
              .groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas())  # DIMS rows at most
    p = np.ones((2, DIMS))
    p[0][counts["bucket"]] += counts["n0"]
    p[1][counts["bucket"]] += counts["n1"]
    ratio = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())
    fit = (rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_fit))
    sample = (docs.select("doc_id", "text").join(F.broadcast(fit), "doc_id").select("h", "label", "text")
              .mapInArrow(_feature_batches, "h long, label int, idx array<int>").toPandas()
              .sort_values(["h", "label"], kind="stable"))
    if sample["label"].nunique() < 2:
        return flat
    xs = []
    for idx in sample["idx"]:
        v = ratio[idx]
        xs.append((np.asarray(idx), v / (np.sqrt((v * v).sum()) or 1.0)))
    y = np.where(sample["label"].to_numpy() == 1, 1.0, -1.0)
    # both classes weigh the same in the loss; every fifth row of each class calibrates
    order = np.zeros(len(y), int)
    for c in (1.0, -1.0):
        order[y == c] = np.arange((y == c).sum())
    held = (order % 5 == 4) & (len(y) >= 50)
    cost = np.where(y > 0, COST * len(y) / (2 * (y > 0).sum()), COST * len(y) / (2 * (y < 0).sum()))
    use = np.flatnonzero(~held)
    w = dual_coordinate_descent([xs[i] for i in use], y[use], DIMS, cost[use])
    test = np.flatnonzero(held) if held.any() and len(set(y[held])) == 2 else np.arange(len(y))
    margins = np.array([(w[xs[i][0]] * xs[i][1]).sum() + w[-1] for i in test])
    return Model(ratio, w, *platt(margins, y[test]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``score``: probability of label 1, of the whole text."""
    def probability(texts):
        features = Features()
        for batch in texts:
            yield pd.Series(model.probability([model.margin(features(t)) for t in batch]), dtype=float)
    probability.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("score", F.pandas_udf("double")(probability)(F.col(text)))
