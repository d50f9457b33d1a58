"""Tables behind figures: heatmaps, similarity matrices with leaf order, densities and growth bands."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contig_key(contig: str) -> tuple[str, int]:
    """Natural order: prefix, then number."""
    m = re.match(r"^(.*?)(\d+)$", contig)
    return (m[1], int(m[2])) if m else (contig, -1)


def contig_order(df: DataFrame, column: str = "contig") -> DataFrame:
    """Adds the two parts of the natural order of contigs as columns."""
    number = F.regexp_extract(column, r"(\d+)$", 1)
    return df.withColumns({"contig_prefix": F.regexp_replace(column, r"\d+$", ""), "contig_number": F.coalesce(number.try_cast("int"), F.lit(-1))})


def class_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of one or two category columns: strictness, evidence by source, match classes."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def heatmap(rows: DataFrame, value: str, samples: list[str]) -> DataFrame:
    """One row per window and a column per sample; the pivot's values are given, so no extra pass looks for them."""
    return rows.groupBy("contig", "w", "start", "end").pivot("sample", samples).agg(F.first(value))


def mean_similarity(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("sample_a", "sample_b").agg(F.avg("similarity").alias("similarity"))


def leaf_order(means: DataFrame, samples: list[str]) -> tuple[list[str], np.ndarray]:
    """Average-linkage order of samples and the matrix in that order; as large as the samples' square, so it runs on the driver."""
    n, at = len(samples), {s: i for i, s in enumerate(samples)}
    matrix = np.eye(n)
    for r in means.collect():
        i, j = at[r["sample_a"]], at[r["sample_b"]]
        matrix[i, j] = matrix[j, i] = r["similarity"]
    groups = [[i] for i in range(n)]
    while len(groups) > 1:
        best, pick = -np.inf, (0, 1)
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                mean = matrix[np.ix_(groups[a], groups[b])].mean()
                if mean > best:  # the first of equal pairs
                    best, pick = mean, (a, b)
        a, b = pick
        groups[a] = groups[a] + groups.pop(b)
    order = groups[0]
    return [samples[i] for i in order], matrix[np.ix_(order, order)]


def density_profile(windows: DataFrame) -> DataFrame:
    return contig_order(windows.select("contig", "w", "start", "end", "n_variants", "density_variants_per_kb")).orderBy("contig_prefix", "contig_number", "w")


def plot_index(windows: DataFrame) -> DataFrame:
    """Per contig: its windows and its extent."""
    return windows.groupBy("contig").agg(F.count_distinct("w").alias("n_windows"), F.min("start").alias("start"), F.max("end").alias("end"))


def histogram_edges(top: float, n: int) -> list[float]:
    """Edges from 0 to the top score + 0.05 in at most 30 bins."""
    return [float(x) for x in np.linspace(0.0, top + 0.05, min(30, n + 2))]
