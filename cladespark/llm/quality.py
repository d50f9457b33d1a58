"""Quality classifier: document evidence shrunk towards host and path posteriors by hierarchical empirical Bayes.

Evidence is a text classifier: a logistic model on the relative frequencies of
hashed words, word shapes (runs of letters, capitals and digits folded, everything
else as it stands) and pairs of both, fitted by AdaGrad. Scores on folds left
out of the fit calibrate it (Platt), so a document's evidence is an honest log
likelihood ratio and not the certainty of a model that has seen it.

Sites (hosts) and the paths below them have Beta priors on their share of good
documents: a site's posterior mean shrinks its own mean towards the global share,
a path's towards its site, so a sparse path falls back on its site and a sparse
site on the corpus. The strength of each level is a moment estimate: the spread of
groups about their own parents, less what sampling within groups explains. A
document's final probability combines its evidence with its path's prior. Counts
come from grouped partial aggregates over all documents; only the text
model is fitted on the driver, on at most ``SAMPLE`` labelled rows (those with the
least hashed ids), of which just the hashed features are collected.

Defined cases: null and empty texts have no features and get the model's bias;
null site or path values are a group of their own; an id with several labels
counts as bad if any says so, one with several texts is learned from the text with
the least hash; without labels of both classes the model is neutral and every
document is kept; repeated rows are scored alike; an empty table gives an empty
table; further columns are kept by ``keep_good``, whatever their names, and
ignored by ``quality``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.llm.common import bounded_batches, free_names, give_back, sliced, written

#: Most labelled rows that the document model is fitted on, and buckets of hashed features.
SAMPLE, BITS = 8_000, 18
#: Bounds of the strength (in pseudo-documents) with which a site or path is held to its parent.
STRENGTH = (1.0, 100_000.0)
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shape(word: str) -> str:
    """A word with its letters folded to a, Aa or A, its digits to 0, and everything else as it stands, runs cut to three."""
    folded = _LETTERS.sub(lambda m: "a" if m[0].islower() else "Aa" if m[0][1:].islower() else "A", word)
    folded = _DIGITS.sub("0", folded)
    return re.sub(r"(.)\1{2,}", r"\1\1\1", folded)[:24]


class Features:
    """Hashed buckets of texts; the two hashes of each word are cached in a bounded table."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = np.uint64(2**bits - 1), {}

    def _hash(self, word: str) -> tuple[int, int]:
        if len(self.known) >= 100_000:
            self.known.clear()
        found = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")), zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) | 1 << 32
        if len(word) <= 64:
            self.known[word] = found
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        """Buckets of words, shapes and pairs of neighbours of both, repeats included."""
        known = self.known.get
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64)
        h = np.array([known(w) or self._hash(w) for w in words], np.uint64)
        parts = [h * _ODD[0], h[:-1] * _ODD[1] + h[1:] * _ODD[2]]
        mixed = np.concatenate([p.ravel() for p in parts])
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _ODD[3]
        return ((mixed >> np.uint64(40)) & self.mask).astype(np.int64)


def _train(flat: np.ndarray, value: np.ndarray, start: np.ndarray, y: np.ndarray, rows: np.ndarray, epochs: int = 6, rate: float = 2.0, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad over ``rows`` of a sparse matrix (flat columns and values, row starts)."""
    w, g2, b, b2 = np.zeros(2**BITS), np.full(2**BITS, 1e-8), 0.0, 1e-8
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, len(order), 32):
            own = order[at : at + 32]
            size = start[own + 1] - start[own]
            pick = np.repeat(start[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
            col, val, row = flat[pick], value[pick], np.repeat(np.arange(len(own)), size)
            z = np.bincount(row, w[col] * val, len(own)) + b
            err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[own]) / len(own)
            touched, inverse = np.unique(col, return_inverse=True)
            g = np.bincount(inverse, err[row] * val) + ridge * w[touched]
            g2[touched] += g * g
            w[touched] -= rate * g / np.sqrt(g2[touched])
            b2 += err.sum() ** 2
            b -= 0.1 * err.sum() / math.sqrt(b2)
    return w, b


def _scores(flat, value, start, rows, w, b) -> np.ndarray:
    return np.array([w[flat[start[r] : start[r + 1]]] @ value[start[r] : start[r + 1]] + b for r in rows])


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make z a calibrated logit, with a weak ridge towards a slope of one."""
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -35, 35)))
        g = np.array([((p - y) * z).sum() + (a - 1), (p - y).sum()])
        s = p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), c


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in sliced(batches):
        cols, counts = [], []
        for text in batch.column(2).to_pylist():
            found, n = np.unique(features(text), return_counts=True)
            cols.append(found.astype(np.int32))
            counts.append((n / max(1, n.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], names=["h", "y", "f", "v"])


def fit_document_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """Weights of the document model, its bias and calibration, and the share of good rows among the labelled."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    bounded = written(own.orderBy(F.xxhash64("id"), "id").limit(sample), "labelled")
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("t")).join(F.broadcast(bounded), F.col("d_id") == F.col("id"))  # at most ``sample`` rows of two numbers
    rows = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), F.col("t"))).alias("least")).select(F.xxhash64("id").alias("h"), (F.col("y") != 0).cast("int").alias("y"), F.col("least.t").alias("t"))
    got = rows.mapInArrow(_labelled, "h long, y int, f array<int>, v array<float>").toArrow().combine_chunks()
    y = got["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return {"i": np.zeros(0, np.int64), "w": np.zeros(0, np.float32), "bias": 0.0, "base": 0.5}
    lists, values = got["f"].chunk(0), got["v"].chunk(0)
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat, value = lists.values.to_numpy(), values.values.to_numpy().astype(np.float64)
    order = np.argsort(got["h"].to_numpy(), kind="stable")  # doesn't depend on the tasks
    out = np.zeros(len(y))
    for fold in range(2):
        rest = order[np.arange(len(order)) % 2 != fold]
        left = order[np.arange(len(order)) % 2 == fold]
        if len(rest):
            out[left] = _scores(flat, value, ends, left, *_train(flat, value, ends, y, rest))
    a, c = _platt(out, y)
    w, b = _train(flat, value, ends, y, order)
    base = float(np.clip(y.mean(), 0.5 / len(y), 1 - 0.5 / len(y)))
    w *= a
    used = np.flatnonzero(w)
    return {"i": used.astype(np.int32), "w": w[used].astype(np.float32), "bias": a * b + c - math.log(base / (1 - base)), "base": base}


def _evidence(model: dict):
    """An Arrow UDF: text to the log likelihood ratio of good against bad. Only texts go to Python, only numbers come back."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros(2**BITS, np.float32)
        dense[model["i"]] = model["w"]
        features = Features()
        for texts in parts:
            llr = np.full(len(texts), model["bias"])
            for start in range(0, len(texts), 256):  # so that few texts are Python strings at a time
                for i, text in enumerate(texts.slice(start, 256).to_pylist(), start):
                    found = features(text)
                    if len(found):
                        llr[i] += dense[found].mean(dtype=np.float64)
            yield pa.array(np.clip(llr, -30, 30))
        give_back(features.known)

    return score


def _group(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("\x00null"))


def url_levels(docs: DataFrame, url_col: str, host: str = "host", path: str = "path") -> DataFrame:
    """``docs`` with the two levels of a URL: its host and the first part of its path."""
    parts = rf"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?(/[^/?#]*)?"
    return docs.withColumns({host: F.lower(F.regexp_extract(url_col, parts, 1)), path: F.regexp_extract(url_col, parts, 2)})


def posteriors(scored: DataFrame, levels: list[str], base: float) -> DataFrame:
    """One row per path (all ``levels``): ``prior``, the shrunk share of good documents. ``scored`` has the levels and ``llr``."""
    logit = math.log(base / (1 - base))
    p = 1 / (1 + F.exp(-(F.col("llr") + F.lit(logit))))
    paths = scored.select(*levels, p.alias("p")).groupBy(*levels).agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"), F.count("*").alias("n"))
    table = written(paths, "paths")
    total = table.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    share = min(max(total["s"] / total["n"], 0.001), 0.999) if total["n"] else base
    above = None
    for depth in range(1, len(levels) + 1):
        keys = levels[:depth]
        groups = table.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))
        groups = groups.withColumn("up", F.lit(share)) if above is None else groups.join(above.withColumnRenamed("prior", "up"), keys[:-1])
        mean = F.col("s") / F.col("n")
        # the spread about the parents, less the part that comes from finite groups
        spread = groups.agg(F.sum(F.col("n") * (mean - F.col("up")) ** 2).alias("v"), F.sum(F.col("ss") / F.col("n") - mean * mean).alias("e"), F.sum("n").alias("n")).first()
        between = max(0.0, (spread["v"] - spread["e"]) / spread["n"]) if spread["n"] else 0.0
        strength = share * (1 - share) / between - 1 if between > 0 else STRENGTH[1]
        strength = min(max(strength, STRENGTH[0]), STRENGTH[1])
        above = groups.select(*keys, ((F.col("s") + strength * F.col("up")) / (F.col("n") + strength)).alias("prior"))
    return written(above, "posteriors")


def _scored(docs: DataFrame, labels: DataFrame, keep: list[str], levels: tuple[str, ...], id_col: str, text_col: str) -> tuple[DataFrame, str, str, str]:
    """``keep`` columns of ``docs`` with evidence, prior and final probability, and those three's names, which are free ones; texts are read and scored once."""
    bounded_batches(docs.sparkSession)
    model = fit_document_model(docs, labels, id_col, text_col)
    *names, llr, prior, good = free_names(docs, *(f"level{i}" for i in range(len(levels))), "llr", "prior", "good")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), *(_group(c).alias(n) for c, n in zip(levels, names)), _evidence(model)(F.col(text_col)).alias(llr))
    scored = written(rows, "evidence")
    table = posteriors(scored.select(*names, F.col(llr).alias("llr")), names, model["base"]).withColumnRenamed("prior", prior)
    joined = scored.join(table, names, "left")
    return joined.withColumn(good, 1 / (1 + F.exp(-(F.col(llr) + F.log(F.col(prior) / (1 - F.col(prior))))))), llr, prior, good


def quality(docs: DataFrame, labels: DataFrame, levels: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, llr, prior, quality): each document's evidence, its path's prior and its final probability."""
    out, llr, prior, good = _scored(docs, labels, [id_col], levels, id_col, text_col)
    return out.select(id_col, F.col(llr).alias("llr"), F.col(prior).alias("prior"), F.col(good).alias("quality"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, levels: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those whose probability is below ``threshold``."""
    out, _, _, good = _scored(docs, labels, docs.columns, levels, id_col, text_col)
    return out.filter(F.col(good) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
