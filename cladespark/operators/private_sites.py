"""Sites at which all called targets agree on a homozygous allele that not every other sample carries.

One judgement serves three inputs: VCF genotypes (a partly missing genotype
counts by the alleles it has), alignment columns, and assemblies whose
reference allele is implied by coverage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.operators.intervals import consecutive_runs, range_join

#: Names of the four levels (fixed values).
LEVELS = ("strict", "nontarget_shared", "target_partial", "target_partial_nontarget_shared")


#: Why a site doesn't qualify, in the order in which the rules apply (fixed names).
SKIPS = ("no_hom_target", "targets_disagree", "no_nontarget", "all_nontarget_carry")


def verdicts(sites: DataFrame, n_targets: int) -> DataFrame:
    """All sites with ``skip`` (null: it qualifies) from rows with contig, pos, ref, t_calls and o_calls (arrays of the distinct alleles of each called sample)."""
    rows = sites.withColumn("_homs", F.transform(F.filter("t_calls", lambda a: F.size(a) == 1), lambda a: a[0]))
    rows = rows.withColumn("target_allele", F.get("_homs", F.lit(0)))
    carries = F.size(F.filter("o_calls", lambda a: F.array_contains(a, F.col("target_allele"))))
    rows = rows.withColumns({"n_targets_observed": F.size("_homs"), "n_nontarget_observed": F.size("o_calls"), "n_nontarget_carries": F.when(F.size("_homs") > 0, carries).otherwise(0)})
    skip = F.when(F.size("_homs") == 0, SKIPS[0]).when(F.size(F.array_distinct("_homs")) > 1, SKIPS[1]).when(F.size("o_calls") == 0, SKIPS[2]).when(F.col("n_nontarget_carries") >= F.col("n_nontarget_observed"), SKIPS[3])
    level = F.when(F.col("n_targets_observed") == n_targets, 1).otherwise(3) + F.when(F.col("n_nontarget_carries") == 0, 0).otherwise(1)
    others = F.sort_array(F.array_except(F.array_distinct(F.flatten("o_calls")), F.array("target_allele")))
    gap = (F.col("target_allele") == "-") | (F.length("target_allele") != 1) | (F.length("ref") != 1)
    rows = rows.withColumns({"skip": skip, "level": level, "strictness": F.element_at(F.array(*map(F.lit, LEVELS)), level), "nontarget_alleles": others, "classification": F.when(gap, "indel").otherwise("snp")})
    return rows.drop("_homs", "t_calls", "o_calls")


def judged(sites: DataFrame, n_targets: int) -> DataFrame:
    """The qualifying sites."""
    return verdicts(sites, n_targets).filter("skip is null").drop("skip")


def from_vcf(records: DataFrame, samples: list[str], targets: tuple[str, ...]) -> DataFrame:
    """Sites with both groups' calls, from the record's own arrays: no shuffle."""
    alleles = F.concat(F.array("ref"), F.coalesce("alts", F.array().cast("array<string>")))
    called = lambda g: F.array_distinct(F.transform(F.filter(g, lambda a: a.isNotNull()), lambda a: F.get(alleles, a)))

    def pick(names):
        got = F.filter(F.array(*[F.get("gts", F.lit(samples.index(s))) for s in names]), lambda g: g.isNotNull())
        return F.filter(F.transform(got, called), lambda a: F.size(a) > 0)

    return records.select("contig", "pos", "ref", pick(targets).alias("t_calls"), pick([s for s in samples if s not in targets]).alias("o_calls"))


def from_states(states: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """Sites from long rows contig, pos, ref, sample, state; a site's arrays are as long as the cohort."""
    t = F.col("sample").isin(*targets)
    return states.groupBy("contig", "pos", "ref").agg(F.collect_list(F.when(t, F.array("state"))).alias("t_calls"), F.collect_list(F.when(~t, F.array("state"))).alias("o_calls"))


def assembly_states(variants: DataFrame, coverage: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """Long states from variants (contig, pos, sample, ref, alt) and covered intervals (sample, contig, start, end), 1-based closed.

    At each position where any sample varies, a sample without a variant that
    covers it has the reference allele.
    """
    sites = variants.groupBy("contig", "pos").agg(F.min("ref").alias("ref"))
    wide = sites.withColumn("sample", F.explode(F.array(*[F.lit(s) for s in samples])))
    plain = wide.join(variants.select("contig", "pos", "sample", "alt"), ["contig", "pos", "sample"], "left")
    left = plain.filter("alt is null").select("sample", "ref", F.col("contig").alias("a_contig"), F.col("pos").alias("a_start"), (F.col("pos") + 1).alias("a_end"))
    right = coverage.select(F.col("sample").alias("b_sample"), F.col("contig").alias("b_contig"), F.col("start").alias("b_start"), (F.col("end") + 1).alias("b_end"))
    met = range_join(left, right).filter("sample = b_sample").select(F.col("a_contig").alias("contig"), F.col("a_start").alias("pos"), "ref", "sample", F.col("ref").alias("state")).distinct()
    return met.unionByName(plain.filter("alt is not null").select("contig", "pos", "ref", "sample", F.col("alt").alias("state")))


def intervals(sites: DataFrame) -> DataFrame:
    """Runs of consecutive positions: worst level, one class or 'mixed', alleles and extremes."""
    runs = consecutive_runs(sites, ["contig"], "pos")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    out = runs.groupBy("contig", "island").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n_sites"), F.max("level").alias("level"), joined("classification").alias("_c"), joined("target_allele").alias("target_alleles"), joined("ref").alias("ref_alleles"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("nontarget_alleles")))), ",").alias("nontarget_alleles"),
        F.min("n_targets_observed").alias("n_targets_observed"), F.min("n_nontarget_observed").alias("min_nontarget_observed"), F.max("n_nontarget_observed").alias("max_nontarget_observed"), F.max("n_nontarget_carries").alias("max_nontarget_carries"),
    )
    named = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return out.withColumns({"strictness": named, "span_bp": F.col("end") - F.col("start") + 1, "classification": F.when(F.contains("_c", F.lit(",")), "mixed").otherwise(F.col("_c"))}).drop("_c", "island")


def summary(sites: DataFrame, runs: DataFrame) -> DataFrame:
    """(metric, value): sites and intervals in all, by level and by class, and the bases covered."""
    a = sites.groupBy(F.concat(F.lit("sites_"), "strictness").alias("metric")).agg(F.count("*").alias("value"))
    b = runs.groupBy(F.concat(F.lit("intervals_"), "strictness").alias("metric")).agg(F.count("*").alias("value"))
    c = runs.groupBy(F.concat(F.lit("intervals_"), "classification").alias("metric")).agg(F.count("*").alias("value"))
    d = runs.agg(F.coalesce(F.sum("span_bp"), F.lit(0)).alias("value")).select(F.lit("interval_bp").alias("metric"), "value")
    return a.unionByName(b).unionByName(c).unionByName(d)
