"""Scans: private alleles from VCF records and private segments from graphs, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladespark.cohort import Cohort
from cladespark.operators import kernel
from cladespark.operators.intervals import merge_loci, range_join, region_rollup
from cladespark.operators.landscape import missing
from cladespark.sources.vcf import allele_key, genotype_state, genotype_text, variant_type


def segment_length_class(length: Column) -> Column:
    return F.when(length <= 0, "unknown").when(length == 1, "snp_like").when(length < 50, "small_indel_like").when(length < 1000, "sv_like").otherwise("large_sv_like")


def graph_interpretation() -> Column:
    """What a private segment means, by how much of the off-targets was seen (fixed texts)."""
    seen_none = F.col("offtarget_missing_n") == F.col("offtarget_total_n")
    clear = (F.col("offtarget_missing_n") == 0) & (F.col("offtarget_support_n") == 0)
    return (
        F.when(seen_none, "Targets traverse this graph segment; off-target coordinate-overlapping graph coverage was not observed, so this is private-node evidence rather than confirmed alternate-path absence.")
        .when(clear, "Targets traverse this graph segment; off-targets have coordinate-overlapping graph coverage but do not traverse this same segment.")
        .otherwise("Targets traverse this graph segment; off-target same-segment traversal and coordinate coverage are mixed or incomplete.")
    )


def _indices(samples: list[str], names: tuple[str, ...]) -> list[int]:
    return [samples.index(s) for s in names if s in samples]


def vcf_alleles(records: DataFrame, samples: list[str], cohort: Cohort, rules: kernel.Thresholds = kernel.Thresholds(), weights: kernel.Weights = kernel.Weights(), pass_only: bool = True, min_qual: float | None = None, allow_multiallelic: bool = True) -> DataFrame:
    """One classified and scored row per ALT allele. A narrow plan: counts come from the record's own genotype array, so nothing is shuffled."""
    cohort.check_samples(samples)
    rows = records
    if pass_only:
        rows = rows.filter((F.size("filters") == 0) | F.array_contains("filters", "PASS"))
    if min_qual is not None:  # records without QUAL pass
        rows = rows.filter(F.col("qual").isNull() | (F.col("qual") >= min_qual))
    rows = rows.filter("alts is not null")
    if not allow_multiallelic:
        rows = rows.filter(F.size("alts") == 1)
    pick = lambda names: F.filter(F.array(*[F.get("gts", F.lit(i)) for i in _indices(samples, names)]), lambda g: ~missing(g))
    rows = rows.withColumns({"_t": pick(cohort.targets), "_o": pick(cohort.off_targets)})
    rows = rows.select("*", F.posexplode("alts").alias("alt_i", "alt")).filter("alt is not null")
    carry = lambda side: F.size(F.filter(side, lambda g: F.array_contains(g, F.col("alt_i") + 1))).cast("long")
    n_t, n_o = len(cohort.targets), len(cohort.off_targets)
    counted = rows.select(
        "contig", "pos", "start", "end", "ref", "alt", "alt_i", "qual", "gts", "rec_ord",
        carry("_t").alias("target_support_n"), F.lit(n_t).cast("long").alias("target_total_n"), carry("_o").alias("offtarget_support_n"), F.lit(n_o).cast("long").alias("offtarget_total_n"),
        (n_t - F.size("_t")).cast("long").alias("target_missing_n"), (n_o - F.size("_o")).cast("long").alias("offtarget_missing_n"),
    )
    graded = kernel.score(kernel.classify(counted, rules), weights)
    return graded.withColumns({"variant_type": variant_type(F.col("ref"), F.col("alt")), "allele_key": allele_key(F.col("contig"), F.col("pos"), F.col("ref"), F.col("alt"))})


def with_ids(hits: DataFrame, prefix: str, *order) -> DataFrame:
    """Adds ord and locus_id, numbered in scan order from 1."""
    return kernel.numbered(hits, "ord", *order, start=1).withColumn("locus_id", F.format_string(f"{prefix}%08d", "ord"))


def scan_vcf(records: DataFrame, samples: list[str], contigs: list[str], cohort: Cohort, **options) -> DataFrame:
    """Passing alleles with ids in header contig order, then file order, then ALT order, and their ranks."""
    hits = vcf_alleles(records, samples, cohort, **options).filter("pattern_pass")
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in contigs]), F.col("contig")), F.lit(0)) if contigs else F.lit(0)
    return kernel.ranked(with_ids(hits.withColumn("_c", place), "PPX", F.col("_c").asc(), F.col("rec_ord").asc(), F.col("alt_i").asc()).drop("_c"))


#: Metrics of a scan in output order, with what they mean (fixed names).
QC_METRICS = (
    ("records_evaluated", "records read"), ("records_skipped_filter", "records that failed FILTER"), ("records_skipped_qual", "records below the QUAL threshold"), ("records_skipped_multiallelic", "records left out as multiallelic"),
    ("alleles_evaluated", "alleles classified"), ("alleles_passed", "alleles that passed"), ("alleles_contradicted", "alleles contradicted by off-targets"), ("loci_emitted", "rows of hits"), ("regions_emitted", "rows of regions"),
    ("n_target_samples", "target samples found"), ("n_offtarget_samples", "off-target samples found"), ("n_contigs_scanned", "contigs read"),
)


def qc(records: DataFrame, alleles: DataFrame, samples: list[str], cohort: Cohort, regions: DataFrame | None = None, pass_only: bool = True, min_qual: float | None = None, allow_multiallelic: bool = True, **_) -> dict[str, int]:
    """Counters of a scan: one pass over the records and one over the classified alleles. Rules apply in order; the first that fails counts."""
    passed = (F.size("filters") == 0) | F.array_contains("filters", "PASS") | F.lit(not pass_only)
    good = F.lit(True) if min_qual is None else F.col("qual").isNull() | (F.col("qual") >= min_qual)
    single = F.lit(allow_multiallelic) | (F.coalesce(F.size("alts"), F.lit(0)) <= 1)
    r = records.agg(F.count("*").alias("n"), F.count_if(~passed).alias("f"), F.count_if(passed & ~good).alias("q"), F.count_if(passed & good & ~single).alias("m"), F.count_distinct("contig").alias("c")).first()
    counts = alleles.groupBy("strictness_class", "pattern_pass").agg(F.count("*").alias("n")).collect()
    total = lambda test: sum(x["n"] for x in counts if test(x))
    hits = total(lambda x: x["pattern_pass"])
    values = (r["n"], r["f"], r["q"], r["m"], total(lambda x: True), hits, total(lambda x: x["strictness_class"] == "contradicted"), hits, regions.count() if regions is not None else 0, len(set(samples) & set(cohort.targets)), len(set(samples) & set(cohort.off_targets)), r["c"])
    classes = sorted({x["strictness_class"] for x in counts})
    return dict(zip((name for name, _ in QC_METRICS), values)) | {f"strictness_{k}": total(lambda x, k=k: x["strictness_class"] == k) for k in classes}


def regions_of(hits: DataFrame, distance: int = 0, same_type: bool = False, prefix: str = "REGION") -> DataFrame:
    """Merged regions with ids in (contig, start) order."""
    rolled = region_rollup(merge_loci(hits, distance, same_type))
    rows = kernel.numbered(rolled, "n", F.col("contig").asc(), F.col("start").asc(), F.col("island").asc())
    return rows.withColumn("region_id", F.format_string(f"{prefix}%06d", "n")).drop("n")


def sample_support(hits: DataFrame, samples: list[str], cohort: Cohort) -> DataFrame:
    """Per hit and cohort sample: genotype, whether any non-reference allele is there, and the evidence class by role."""
    entries = [F.struct(F.lit(s).alias("sample_id"), F.lit(role).alias("cohort_role"), (F.get("gts", F.lit(samples.index(s))) if s in samples else F.lit(None).cast("array<int>")).alias("gt"), F.lit(k).alias("k")) for k, (s, role) in enumerate([(s, "target") for s in cohort.targets] + [(s, "off_target") for s in cohort.off_targets])]
    rows = hits.select("locus_id", "rank", F.inline(F.array(*entries)))
    return rows.select("locus_id", "rank", "k", "sample_id", "cohort_role", genotype_text(F.col("gt")).alias("genotype"), genotype_state(F.col("gt")).alias("state"), F.coalesce(F.exists("gt", lambda a: a > 0), F.lit(False)).alias("allele_supported"), _evidence_class().alias("evidence_class"))


def _evidence_class() -> Column:
    lost = missing(F.col("gt"))
    has = F.coalesce(F.exists("gt", lambda a: a > 0), F.lit(False))
    target = F.col("cohort_role") == "target"
    return F.when(lost, "uninformative").when(has, F.when(target, "support").otherwise("contradiction")).otherwise(F.when(target, "ambiguous").otherwise("absence"))


def scan_gfa(index: dict[str, DataFrame], cohort: Cohort, rules: kernel.Thresholds = kernel.Thresholds(), weights: kernel.Weights = kernel.Weights(), min_length: int = 1, region=(None, None, None)) -> DataFrame:
    """Classified and scored segments that some target traverses.

    A sample is present at a segment if it traverses it or covers its interval
    by other segments; only present samples are called.
    """
    from cladespark.sources.text import in_region

    roles = [*cohort.targets, *cohort.off_targets]
    seg = index["segments"].filter(in_region(F.col("contig"), F.col("start"), F.col("end"), region) & (F.col("end") - F.col("start") >= min_length))
    walked = index["segment_sample"].filter(F.col("sample").isin(*roles))
    # reject early: segments without a target never meet the interval join
    wanted = seg.join(walked.filter(F.col("sample").isin(*cohort.targets)).select("name").distinct(), "name", "left_semi")
    covered = range_join(wanted.select("name", F.col("contig").alias("a_contig"), F.col("start").alias("a_start"), F.col("end").alias("a_end")), index["coverage"].filter(F.col("sample").isin(*roles)).select("sample", F.col("contig").alias("b_contig"), F.col("start").alias("b_start"), F.col("end").alias("b_end")))
    calls = covered.select("name", "sample", F.lit(0).alias("w")).unionByName(walked.join(wanted.select("name"), "name", "left_semi").select("name", "sample", F.lit(1).alias("w")))
    calls = calls.groupBy("name", "sample").agg(F.max("w").alias("w")).select(F.col("name").alias("locus_key"), "sample", F.when(F.col("w") == 1, "carry").otherwise("absent").alias("state"))
    graded = kernel.classify(kernel.cohort_counts(calls, cohort), rules)
    rows = graded.withColumnRenamed("locus_key", "name").join(wanted, "name").withColumn("qual", F.lit(None).cast("double"))
    length = F.col("end") - F.col("start")
    rows = kernel.score(rows, weights)
    return rows.withColumns({"variant_type": F.lit("graph_region"), "segment_length_class": segment_length_class(length), "allele_key": F.concat_ws(":", "contig", F.col("start") + 1, F.lit("SEG"), "name")})


def gfa_hits(scanned: DataFrame) -> DataFrame:
    return kernel.ranked(with_ids(scanned.filter("pattern_pass"), "GPX", F.col("contig").asc(), F.col("start").asc(), F.col("end").asc(), F.col("name").asc()))
