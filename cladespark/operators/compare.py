"""Comparing two hit tables: overlap matches, nearest fallback, and what only one side has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladespark.functions.rounding import half_even
from cladespark.operators.intervals import best, range_join

CLASSES = ("supported", "partially_supported", "contradicted", "source_specific", "uninformative", "novel")
STRICT = ("strict_complete", "strict_target_missing", "strict_offtarget_missing", "strict_both_missing")


@dataclass(frozen=True)
class CompareRules:
    overlap_mode: str = "contained"
    min_reciprocal_overlap: float = 0.5
    breakpoint_tolerance_bp: int = 200
    require_state_compatibility: bool = False
    normalize_contigs: bool = True


def canonical_contig(contig: Column, normalize: bool = True) -> Column:
    """What follows the last # of a contig name."""
    return F.element_at(F.split(contig, "#"), -1) if normalize else contig


def state_compatible(a: Column, b: Column, require: bool) -> Column:
    ok = (a != "contradicted") & (b != "contradicted")
    return ok & (a.isin(*STRICT) == b.isin(*STRICT)) if require else ok


def match_class(overlap: Column, compatible: Column, a: Column, b: Column, method: Column, require: bool) -> Column:
    rule = F.when((a == "contradicted") | (b == "contradicted"), "contradicted")
    rule = rule.when(overlap <= 0, F.when(method == "breakpoint", "partially_supported").otherwise("source_specific"))
    if require:
        rule = rule.when(~compatible, "partially_supported")
    return rule.when(compatible, "supported").otherwise("partially_supported")


def comparison_score(name: Column, overlap: Column) -> Column:
    scaled = lambda base: half_even(F.lit(base) * F.greatest(overlap, F.lit(0.01)), 4)
    return F.when(name == "supported", scaled(1.0)).when(name == "partially_supported", scaled(0.5)).when(name == "source_specific", 0.3).otherwise(0.0)


def _side(hits: DataFrame, letter: str, rules: CompareRules) -> DataFrame:
    return hits.select(
        F.col("locus_id").alias(f"locus_id_{letter}"), canonical_contig(F.col("contig"), rules.normalize_contigs).alias(f"{letter}_contig"), F.col("contig").alias(f"contig_{letter}"),
        F.col("start").alias(f"{letter}_start"), F.col("end").alias(f"{letter}_end"), F.col("strictness_class").alias(f"strictness_{letter}"), F.col("final_score").alias(f"score_{letter}"), F.col("ord").alias(f"{letter}_ord"),
    )


def candidate_pairs(a: DataFrame, b: DataFrame, rules: CompareRules, width: int = 16_384) -> DataFrame:
    """All pairs within the tolerance, with their overlap measures: one range join serves both match kinds."""
    left, right = _side(a, "a", rules), _side(b, "b", rules)
    pairs = range_join(left, right, width, rules.breakpoint_tolerance_bp)
    both = F.greatest(F.lit(0), F.least("a_end", "b_end") - F.greatest("a_start", "b_start"))
    span = F.greatest("a_end", "b_end") - F.least("a_start", "b_start")
    pairs = pairs.withColumn("intersection_bp", both)
    part = lambda s: F.when(F.col(f"{s}_end") > F.col(f"{s}_start"), F.col("intersection_bp") / (F.col(f"{s}_end") - F.col(f"{s}_start"))).otherwise(0.0)
    pairs = pairs.withColumns({
        "reciprocal": F.when(F.col("intersection_bp") > 0, F.col("intersection_bp") / span).otherwise(0.0),
        "containment": F.when(F.col("intersection_bp") > 0, F.least(F.lit(1.0), F.greatest(part("a"), part("b")))).otherwise(0.0),
        "distance": F.greatest(F.lit(0), F.greatest("a_start", "b_start") - F.least("a_end", "b_end")),
    })
    score = F.col("reciprocal") if rules.overlap_mode == "reciprocal" else F.col("containment")
    passes = F.col("intersection_bp") > 0
    if rules.overlap_mode != "any":
        passes &= score >= rules.min_reciprocal_overlap
    return pairs.withColumns({"overlap": score, "passes": passes})


def matches(a: DataFrame, b: DataFrame, rules: CompareRules = CompareRules(), width: int = 16_384) -> DataFrame:
    """Every pair: overlaps that pass, best first, and for rows of ``a`` with none the nearest within the tolerance."""
    pairs = candidate_pairs(a, b, rules, width)
    overlap = pairs.filter("passes").withColumn("method", F.lit("overlap"))
    found = overlap
    if rules.breakpoint_tolerance_bp > 0:
        # below-threshold overlaps have distance 0 and count as breakpoint matches with overlap 0
        rest = pairs.join(overlap.select("a_ord").distinct(), "a_ord", "left_anti").filter(F.col("distance") <= rules.breakpoint_tolerance_bp)
        near = best(rest, ["a_ord"], "distance", "b_start", "b_end", "b_ord")
        found = overlap.unionByName(near.withColumns({"overlap": F.lit(0.0), "method": F.lit("breakpoint")}))
    fits = state_compatible(F.col("strictness_a"), F.col("strictness_b"), rules.require_state_compatibility)
    found = found.withColumn("state_compatibility", fits)
    found = found.withColumn("match_class", match_class(F.col("overlap"), F.col("state_compatibility"), F.col("strictness_a"), F.col("strictness_b"), F.col("method"), rules.require_state_compatibility))
    return found.withColumn("comparison_score", comparison_score(F.col("match_class"), F.col("overlap")))


COLUMNS = ("locus_id_a", "locus_id_b", "contig", "start_a", "end_a", "start_b", "end_b", "match_class", "overlap", "state_compatibility", "strictness_a", "strictness_b", "comparison_score", "method", "distance")


def compare(a: DataFrame, b: DataFrame, rules: CompareRules = CompareRules(), width: int = 16_384) -> DataFrame:
    """Matches and the rows of either side without one, with ``part`` and ordinals that give the output order."""
    pairs = matches(a, b, rules, width)
    out = pairs.select(
        "locus_id_a", "locus_id_b", F.col("contig_a").alias("contig"), F.col("a_start").alias("start_a"), F.col("a_end").alias("end_a"), F.col("b_start").alias("start_b"), F.col("b_end").alias("end_b"),
        "match_class", "overlap", "state_compatibility", "strictness_a", "strictness_b", "comparison_score", "method", "distance",
        F.lit(0).alias("part"), F.col("a_ord").alias("ord"), "reciprocal", "intersection_bp", "score_b", F.col("b_start").alias("o1"), F.col("b_end").alias("o2"), F.col("b_ord").alias("o3"),
    )
    only_a = a.join(pairs.select(F.col("a_ord").alias("ord")).distinct(), "ord", "left_anti")
    used = pairs.filter("match_class <> 'source_specific'").select(F.col("locus_id_b").alias("locus_id")).distinct()
    only_b = b.join(used, "locus_id", "left_anti")

    def alone(df: DataFrame, letter: str, part: int) -> DataFrame:
        other = "b" if letter == "a" else "a"
        return df.select(
            F.col("locus_id").alias(f"locus_id_{letter}"), F.lit(None).cast("string").alias(f"locus_id_{other}"), "contig", F.col("start").alias(f"start_{letter}"), F.col("end").alias(f"end_{letter}"),
            F.lit("source_specific").alias("match_class"), F.lit(0.0).alias("overlap"), F.col("strictness_class").alias(f"strictness_{letter}"), F.lit(0.3).alias("comparison_score"), F.lit(part).alias("part"), F.col("ord"),
        )

    return out.unionByName(alone(only_a, "a", 0), allowMissingColumns=True).unionByName(alone(only_b, "b", 1), allowMissingColumns=True)


def in_output_order(rows: DataFrame) -> DataFrame:
    """Adds compare_id: rows of A in file order with their matches best first, then rows only B has."""
    from cladespark.operators.ordering import global_row_number

    order = ["part", "ord", F.col("overlap").desc_nulls_last(), F.col("reciprocal").desc_nulls_last(), F.col("intersection_bp").desc_nulls_last(), F.col("score_b").desc_nulls_last(), "o1", "o2", "o3"]
    out = global_row_number(rows, "n", *order, start=1)
    return out.withColumn("compare_id", F.format_string("CMP%06d", "n"))


def summary(rows: DataFrame) -> DataFrame:
    """Per class: count, share and means of what the compare table shows (overlaps with four decimals), dense over all classes."""
    from cladespark.operators.scaffold import dense

    got = rows.groupBy("match_class").agg(F.count("*").alias("n_loci"), F.avg(half_even(F.when(F.col("method").isNotNull(), F.col("overlap")), 4)).alias("mean_overlap"), F.avg("comparison_score").alias("mean_score"))
    full = dense(got, {"match_class": list(CLASSES)}, {"n_loci": 0})
    total = F.sum("n_loci").over(_all())
    return full.withColumn("pct_total", F.when(total > 0, 100 * F.col("n_loci") / total).otherwise(0.0))


def diagnostics(a: DataFrame, b: DataFrame, rows: DataFrame, rules: CompareRules) -> dict:
    """Contigs of both sides, raw and canonical, with up to ten of those only one side has, and how the search went."""
    out: dict = {"normalize_contigs": rules.normalize_contigs, "overlap_mode": rules.overlap_mode}
    for kind, normal in (("raw", False), ("canonical", rules.normalize_contigs)):
        ca, cb = (df.select(canonical_contig(F.col("contig"), normal).alias("c")).distinct() for df in (a, b))
        first = lambda df: [r["c"] for r in df.orderBy("c").limit(10).collect()]
        out |= {f"{kind}_contigs_a": ca.count(), f"{kind}_contigs_b": cb.count(), f"{kind}_shared_contigs": ca.intersect(cb).count(), f"{kind}_only_contigs_a_sample": first(ca.subtract(cb)), f"{kind}_only_contigs_b_sample": first(cb.subtract(ca))}
    own, other = a.select(canonical_contig(F.col("contig"), rules.normalize_contigs).alias("c")), b.select(canonical_contig(F.col("contig"), rules.normalize_contigs).alias("c")).distinct()
    with_contig, n = own.join(other, "c", "left_semi").count(), a.count()
    pairs = candidate_pairs(a, b, rules).agg(F.count("*").alias("n"), F.count_if(F.col("intersection_bp") > 0).alias("o"), F.count_if("passes").alias("p")).first()
    classes = {r["match_class"]: r["count"] for r in rows.groupBy("match_class").count().collect()}
    methods = {r["method"]: r["count"] for r in rows.groupBy("method").count().collect()}
    return out | {
        "rows_a_with_candidate_contig": with_contig, "rows_a_without_candidate_contig": n - with_contig, "candidate_pairs_checked": pairs["n"], "overlapping_candidate_pairs": pairs["o"], "qualifying_overlap_pairs": pairs["p"],
        "overlap_matches": methods.get("overlap", 0), "breakpoint_fallback_matches": methods.get("breakpoint", 0), "matched_pairs": sum(classes.get(c, 0) for c in CLASSES[:3]), "match_class_counts": classes,
    }


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # over a handful of summary rows
