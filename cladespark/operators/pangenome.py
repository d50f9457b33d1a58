"""Feature matrices: group counts, categories, histograms and growth curves.

``features(feature_id, contig, start, length_bp)`` and the long sparse table
``presence(feature_id, sample)``; groups may overlap, so they are a bridge table
(group, sample) and not a grouping of samples.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladespark.operators.scaffold import dense

CATEGORIES = ("absent", "private", "accessory", "core")


def category(present: Column, size: Column) -> Column:
    """absent, core (tested before private), private or accessory."""
    return F.when(present == 0, "absent").when(present == size, "core").when(present == 1, "private").otherwise("accessory")


def feature_group_counts(features: DataFrame, presence: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """(feature_id, length_bp, grp, present_n): one partial-aggregating shuffle over presence, dense over groups."""
    flags = [F.count_if(F.col("sample").isin(*names)).alias(g) for g, names in groups.items()]
    counts = presence.distinct().groupBy("feature_id").agg(*flags)
    wide = features.select("feature_id", "length_bp").join(counts, "feature_id", "left").na.fill(0)
    stack = ", ".join(f"'{g}', `{g}`, {len(names)}L" for g, names in groups.items())
    return wide.select("feature_id", "length_bp", F.expr(f"stack({len(groups)}, {stack}) as (grp, present_n, group_size)"))


def feature_summary(features: DataFrame, presence: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per feature: counts and categories by group and whether only one side has it."""
    rows = feature_group_counts(features, presence, groups)
    pick = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c)))
    kind = rows.withColumn("category", category(F.col("present_n"), F.col("group_size")))
    out = kind.groupBy("feature_id", "length_bp").agg(*[pick(g, "present_n").alias(f"{g}_present_n") for g in groups], *[pick(g, "category").alias(f"{g}_category") for g in groups])
    t, o = F.col("target_present_n"), F.col("off_target_present_n")
    return out.withColumns({"total_present_n": t + o, "target_private": (t > 0) & (o == 0), "off_target_private": (o > 0) & (t == 0)})


def coverage_histogram(features: DataFrame, presence: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per group and number of samples 0..size: how many features and base pairs are in just so many."""
    rows = feature_group_counts(features, presence, groups).groupBy("grp", "present_n").agg(F.count("*").alias("features"), F.sum("length_bp").alias("bp"))
    spark = features.sparkSession
    frame = spark.createDataFrame([(g, k) for g, names in groups.items() for k in range(len(names) + 1)], "grp string, present_n long")
    return frame.join(rows, ["grp", "present_n"], "left").na.fill(0)


def composition(features: DataFrame, presence: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per group and category: features and base pairs, zeros included."""
    rows = feature_group_counts(features, presence, groups).withColumn("category", category(F.col("present_n"), F.col("group_size")))
    got = rows.groupBy("grp", "category").agg(F.count("*").alias("features"), F.sum("length_bp").alias("bp"))
    return dense(got, {"grp": list(groups), "category": list(CATEGORIES)}, {"features": 0, "bp": 0})


def permutations(groups: dict[str, tuple[str, ...]], trials: int, seed: int) -> list[tuple[str, int, str, int]]:
    """(group, trial, sample, place from 1): each trial shuffles with the Mersenne twister seeded seed + trial - 1."""
    rows = []
    for g, names in groups.items():
        for trial in range(1, trials + 1):
            order = list(names)
            random.Random(seed + trial - 1).shuffle(order)
            rows += [(g, trial, s, n) for n, s in enumerate(order, 1)]
    return rows


def growth_curves(features: DataFrame, presence: DataFrame, groups: dict[str, tuple[str, ...]], trials: int = 100, seed: int = 42) -> DataFrame:
    """Per group, trial and number of samples n: features and base pairs met so far, new ones and those in just one sample.

    Features carried by the same samples behave alike in every trial, so they are
    summed by presence pattern first; the trials meet patterns, not features.
    Per (trial, pattern) only the two lowest places matter: a feature is met
    from the first on and is a singleton until the second. The curves are
    running sums of those two events, without a pass per n.
    """
    spark = features.sparkSession
    names = sorted({s for own in groups.values() for s in own})
    index = F.create_map(*[F.lit(x) for k, s in enumerate(names) for x in (s, k)])
    carriers = presence.filter(F.col("sample").isin(*names)).select("feature_id", index[F.col("sample")].alias("k")).distinct().groupBy("feature_id").agg(F.sort_array(F.collect_set("k")).alias("pattern"))
    patterns = carriers.join(features.select("feature_id", "length_bp"), "feature_id").groupBy("pattern").agg(F.count("*").alias("features"), F.sum("length_bp").alias("bp"))
    # one row per group and trial: the place of each sample, null outside the group
    shuffles: dict[tuple[str, int], list[int | None]] = {}
    for g, trial, sample, place in permutations(groups, trials, seed):
        shuffles.setdefault((g, trial), [None] * len(names))[names.index(sample)] = place
    orders = spark.createDataFrame([(g, t, own) for (g, t), own in shuffles.items()], "grp string, trial int, places array<int>")
    met = patterns.crossJoin(F.broadcast(orders))  # groups x trials rows, parameters of the call
    met = met.withColumn("at", F.array_sort(F.array_compact(F.transform("pattern", lambda k: F.get("places", k)))))
    met = met.select("grp", "trial", "features", "bp", F.get("at", F.lit(0)).alias("p1"), F.get("at", F.lit(1)).alias("p2")).filter("p1 is not null")
    first = met.groupBy("grp", "trial", F.col("p1").alias("n")).agg(F.sum("features").alias("new_features"), F.sum("bp").alias("new_bp"))
    second = met.filter("p2 is not null").groupBy("grp", "trial", F.col("p2").alias("n")).agg(F.sum("features").alias("ended"))
    frame = orders.select("grp", "trial", F.explode(F.array_compact("places")).alias("n"))
    rows = frame.join(first, ["grp", "trial", "n"], "left").join(second, ["grp", "trial", "n"], "left").na.fill(0)
    w = Window.partitionBy("grp", "trial").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("grp", "trial", "n", F.sum("new_features").over(w).alias("features"), F.sum("new_bp").over(w).alias("bp"), "new_features", "new_bp", (F.sum("new_features").over(w) - F.sum("ended").over(w)).alias("singletons"))


def growth_summary(curves: DataFrame) -> DataFrame:
    """Mean and linear 2.5 and 97.5 % quantiles per group and n."""
    return curves.groupBy("grp", "n").agg(F.avg("features").alias("mean_features"), F.avg("bp").alias("mean_bp"), F.percentile("features", F.lit(0.025)).alias("low"), F.percentile("features", F.lit(0.975)).alias("high"))
