"""The discovery kernel: cohort counts, strictness, scores and ranks.

Inputs are relational: ``calls(locus_key, sample, state)`` with state carry,
absent or missing (a row left out is missing) and ``cohort(sample, role)``.
Totals come from the cohort's size, so "no row" and "missing" are the same and
a missing genotype never turns into an absent one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladespark.cohort import Cohort
from cladespark.functions.rounding import half_even

COUNTS = ("target_support_n", "target_total_n", "offtarget_support_n", "offtarget_total_n", "target_missing_n", "offtarget_missing_n")


@dataclass(frozen=True)
class Thresholds:
    """When a pattern passes."""

    min_target_support: float = 1.0
    max_offtarget_support: float = 0.0
    relaxed_target_missing: float | None = None
    relaxed_offtarget_missing: float | None = None


@dataclass(frozen=True)
class Weights:
    discovery: float = 1.0
    support: float = 0.7
    penalty: float = 0.8


def cohort_counts(calls: DataFrame, cohort: Cohort, key: str = "locus_key") -> DataFrame:
    """The six counts for each locus, in one partial-aggregating shuffle.

    Roles are literals in the plan, so there is no join with the cohort, and
    calls of other samples are filtered before the shuffle.
    """
    state, sample = F.col("state"), F.col("sample")
    is_target = sample.isin(*cohort.targets)
    own = calls.filter(sample.isin(*cohort.targets, *cohort.off_targets) & (state != "missing"))
    n_t, n_o = len(cohort.targets), len(cohort.off_targets)
    return own.groupBy(key).agg(
        F.count_if(is_target & (state == "carry")).alias("target_support_n"),
        F.lit(n_t).cast("long").alias("target_total_n"),
        F.count_if(~is_target & (state == "carry")).alias("offtarget_support_n"),
        F.lit(n_o).cast("long").alias("offtarget_total_n"),
        (F.lit(n_t) - F.count_if(is_target)).cast("long").alias("target_missing_n"),
        (F.lit(n_o) - F.count_if(~is_target)).cast("long").alias("offtarget_missing_n"),
    )


def _share(n: str, called: Column) -> Column:
    return F.when(called > 0, F.col(n) / called)


def target_support() -> Column:
    return _share("target_support_n", F.col("target_total_n") - F.col("target_missing_n"))


def offtarget_support() -> Column:
    return _share("offtarget_support_n", F.col("offtarget_total_n") - F.col("offtarget_missing_n"))


def missing_share(side: str) -> Column:
    return F.when(F.col(f"{side}_total_n") > 0, F.col(f"{side}_missing_n") / F.col(f"{side}_total_n")).otherwise(F.lit(0.0))


def classify(counts: DataFrame, rules: Thresholds = Thresholds()) -> DataFrame:
    """Adds strictness_class, pattern_pass and pattern_reason; one CASE, so it stays inside generated code."""
    p_t, p_o = target_support(), offtarget_support()
    tm, om = F.col("target_missing_n") > 0, F.col("offtarget_missing_n") > 0
    four = lambda c: F.format_string("%.4f", half_even(c, 4))

    def verdict(name: Column | str, ok: bool, reason: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("c"), F.lit(ok).alias("p"), reason.alias("r"))

    by_side = F.when(tm & om, "strict_both_missing").when(tm, "strict_target_missing").otherwise("strict_offtarget_missing")
    rule = F.when(p_o > rules.max_offtarget_support, verdict("contradicted", False, F.concat(F.lit("off-target support "), four(p_o), F.lit(f" > threshold {rules.max_offtarget_support}"))))
    rule = rule.when(p_t.isNull(), verdict(F.when(om, "strict_both_missing").otherwise("strict_target_missing"), False, F.lit("all target samples are missing/uninformative")))
    rule = rule.when(p_t < rules.min_target_support, verdict("relaxed_threshold", False, F.concat(F.lit("target support "), four(p_t), F.lit(f" < threshold {rules.min_target_support}"))))
    rule = rule.when(~tm & ~om, verdict("strict_complete", True, F.lit("all targets support; all off-targets confidently absent; no missing data")))
    for side, text, limit in (("target", "target", rules.relaxed_target_missing), ("offtarget", "off-target", rules.relaxed_offtarget_missing)):
        if limit is not None:
            share = missing_share(side)
            rule = rule.when(share > limit, verdict("relaxed_threshold", True, F.concat(F.lit(f"{text} missingness "), four(share), F.lit(f" > relaxed threshold {limit}"))))
    last = F.format_string("passes with missingness: target_missing=%d, offtarget_missing=%d", F.col("target_missing_n"), F.col("offtarget_missing_n"))
    rule = rule.otherwise(verdict(by_side, True, last))
    return counts.withColumn("_v", rule).withColumns({"strictness_class": F.col("_v.c"), "pattern_pass": F.col("_v.p"), "pattern_reason": F.col("_v.r")}).drop("_v")


def score(df: DataFrame, weights: Weights = Weights(), qual: str = "qual", support: str | None = None) -> DataFrame:
    """Adds discovery, support, penalty and final scores; each part is rounded before the sum, as ranks depend on it."""
    strict = F.when(F.col("strictness_class") == "strict_complete", 0.2).otherwise(0.0)
    by_qual = F.when(F.col(qual).isNotNull(), F.least(F.col(qual) / 60.0, F.lit(1.0)) * 0.1).otherwise(0.0)
    base = (F.coalesce(target_support(), F.lit(0.0)) + (1.0 - F.coalesce(offtarget_support(), F.lit(0.0)))) / 2.0
    discovery = half_even(F.least(base + strict + by_qual, F.lit(2.0)) * weights.discovery, 6)
    backing = half_even(F.least(F.col(support), F.lit(1.0)) * weights.support, 6) if support else F.lit(0.0)
    lost = half_even(F.least(missing_share("target") * 0.4 + missing_share("offtarget") * 0.3, F.lit(1.0)) * weights.penalty, 6)
    penalty = F.when(F.col("strictness_class") == "contradicted", F.lit(round(weights.penalty, 6))).otherwise(lost)
    out = df.withColumns({"discovery_score": discovery, "support_score": F.coalesce(backing, F.lit(0.0)), "penalty_score": penalty})
    return out.withColumn("final_score", half_even(F.col("discovery_score") + F.col("support_score") - F.col("penalty_score"), 6))


def numbered(df: DataFrame, column: str, *order, start: int = 0) -> DataFrame:
    """Adds a gap-free running number in a global order without sending all rows to one task.

    Rows are range-partitioned and sorted; each partition counts its rows, and
    the offsets (one number per partition) come back to the plan. Rows are
    written once so that the numbers don't depend on a second evaluation.
    """
    from cladespark.operators.ordering import global_row_number

    return global_row_number(df, column, *order, start=start)


def ranked(df: DataFrame, ordinal: str = "ord", column: str = "rank") -> DataFrame:
    """Ranks by final_score, ties in scan order."""
    return numbered(df, column, F.col("final_score").desc(), F.col(ordinal).asc(), start=1)


def top(df: DataFrame, n: int, ordinal: str = "ord") -> DataFrame:
    """The n best hits with their ranks: a bounded top-k, so a window over it is small."""
    best = df.orderBy(F.coalesce(F.col("final_score"), F.lit(0.0)).desc(), F.col(ordinal)).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce(F.col("final_score"), F.lit(0.0)).desc(), F.col(ordinal))).cast("long"))
