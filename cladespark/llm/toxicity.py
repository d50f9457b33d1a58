"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs and pairs with one or two
words between them. FTRL-proximal gives each coordinate its own learning rate,
and its L1 term leaves most weights at zero, so what is sent to the executors
is a short list of (bucket, weight). The model is fitted on the driver on at
most ``TOXIC`` + ``CLEAN`` labelled texts (those with the least hashed ids of
each class, held-out ids never among them); scoring covers every whole text
where it is read, without a shuffle. Rates, penalty and class weight were chosen by
log loss on a fold inside the training rows (remainder 1), never on the held-out one.

Defined cases: words are runs of letters, digits and combining marks, lower-cased;
null, empty and wordless texts get the model's bias; null labels are ignored, an id with
several labels counts as toxic if any says so, one with several texts is learned from the
text with the least hash; without labels of both classes every score is
the share of toxic ones (0.0 without any); repeated rows score alike; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.llm.common import bounded_batches, crc_mod

BITS = 20
#: Most labelled texts of each class that the model is fitted on.
TOXIC, CLEAN = 2000, 4000
#: Letters, digits and the marks that \\w leaves out: combining accents, vowel signs of the scripts of India and Thailand, joiners.
_WORD = re.compile("[\\w\u0300-\u036f\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0900-\u0dff\u0e00-\u0eff\u1ab0-\u1aff\u200c\u200d]+")


class Hasher:
    """Distinct hashed word, pair and skip-pair buckets of a text; word hashes are cached in a bounded table."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = np.uint64(2**bits - 1), {}

    def _hash(self, word: str) -> int:
        if len(self.known) >= 400_000:
            self.known.clear()
        found = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self.known[word] = found
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        known = self.known.get
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.int64)
        h = np.array([known(w) or self._hash(w) for w in words], np.uint64)
        parts = [self._bucket(h * np.uint64(0x9E3779B97F4A7C15))]
        for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (3, 0x27D4EB2F165667C5)):
            if len(h) > gap:
                parts.append(self._bucket((h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:]) * np.uint64(odd)))
        return np.unique(np.concatenate(parts))

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(40)) & self.mask).astype(np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss: per-coordinate rates, L1 sparsity, an unregularized bias."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z = self.bias_n = 0.0

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, i: np.ndarray, y: float, weight: float = 1.0) -> None:
        w, b = self.weights(i), self.bias()
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y)
        n = self.n[i]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] = n + g * g
        sigma = ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha
        self.bias_z += g - sigma * b
        self.bias_n += g * g


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0, epochs: int = 8, weight: float = 4.0, toxic: int = TOXIC, clean: int = CLEAN) -> dict:
    """Sparse weights {'i', 'w', 'bias'} learned from labelled ids outside the held-out fold; toxic rows, the rarer ones, count ``weight`` times."""
    own = labels.filter((crc_mod(id_col, folds) != held_out) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    own = own.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("_y"))
    first = lambda y, n: own.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    bounded = first(1, toxic).unionByName(first(0, clean))

    @F.pandas_udf("array<int>")
    def buckets(text: pd.Series) -> pd.Series:
        hasher = Hasher()
        return pd.Series([hasher(t).astype(np.int32) for t in text])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(bounded), "_id")  # at most toxic + clean rows of two numbers
    rows = rows.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), F.col("_t"))).alias("least"))
    # one flat array of buckets: rows of Python objects would take many times the memory on the driver
    got = rows.select(F.xxhash64("_id").alias("h"), "_y", buckets("least._t").alias("x")).toArrow().combine_chunks()
    h, y = got["h"].to_numpy(), got["_y"].to_numpy().astype(float)
    order = np.argsort(h, kind="stable")  # an order that doesn't depend on the tasks
    y = y[order]
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return {"i": np.zeros(0, np.int64), "w": np.zeros(0, np.float32), "bias": 35.0 if share else -35.0}
    lists = got["x"].chunk(0)
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    x = [flat[ends[k] : ends[k + 1]] for k in order]
    return learn(x, y, epochs, weight)


def learn(x: list[np.ndarray], y: np.ndarray, epochs: int, weight: float, **rates: float) -> dict:
    """Sparse weights from bucket lists and their labels."""
    model = Ftrl(2**BITS, **rates)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(x)):
            model.learn(x[k], y[k], weight if y[k] else 1.0)
    every = np.flatnonzero(model.n)
    w = model.weights(every)
    return {"i": every[w != 0], "w": w[w != 0].astype(np.float32), "bias": model.bias()}


def scorer(model: dict):
    """A Pandas UDF: text to the probability that it is toxic."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        dense = np.zeros(2**BITS, np.float32)
        dense[model["i"]] = model["w"]
        hasher = Hasher()
        total = np.array([dense[hasher(t)].sum(dtype=np.float64) for t in text], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(total + model["bias"], -35, 35))))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, folds=folds, held_out=held_out, **options)
    out = docs.select(F.col(id_col), (crc_mod(id_col, folds) == held_out).alias("held_out"), scorer(model)(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
