"""Group-private positions from a VCF, an alignment or assemblies: interval and summary tables."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.operators import kernel, private_sites
from cladespark.operators.ordering import stored
from cladespark.sinks import write_tsv
from cladespark.sources import assembly, sam, vcf, xmfa

INTERVALS = "interval_id chrom strictness strictness_level start end span_bp n_sites classification targets target_alleles ref_alleles nontarget_alleles n_targets_expected n_targets_observed min_nontarget_observed max_nontarget_observed max_nontarget_carries".split()


def sites_of(spark: SparkSession, targets: tuple[str, ...], vcf_path: str | None = None, xmfa_path: str | None = None, reference: str | None = None, assemblies: str | None = None, fasta: str | None = None) -> tuple[DataFrame, list[str]]:
    """Sites with both groups' calls, and all samples, from one kind of input."""
    if vcf_path:
        samples, _ = vcf.header(spark, vcf_path)
        return private_sites.from_vcf(vcf.read_vcf(spark, vcf_path), samples, targets), samples
    if xmfa_path:
        states = xmfa.reference_states(xmfa.read_xmfa(spark, xmfa_path), reference).filter(F.col("sample") != reference)
        samples = [r["sample"] for r in states.select("sample").distinct().orderBy("sample").collect()]
        return private_sites.from_states(states, targets), samples
    with open(assemblies, encoding="utf-8", newline="") as f:  # a path and a sample a line
        pairs = [(r[0], r[1]) for r in csv.reader((x for x in f if x.strip() and not x.startswith("#")), delimiter="\t")]
    reads = None
    for path, sample in pairs:
        own = sam.read_sam(spark, path, sample)
        reads = own if reads is None else reads.unionByName(own)
    variants, coverage = assembly.differences(reads, assembly.read_fasta(spark, fasta))
    samples = [s for _, s in pairs]
    return private_sites.from_states(private_sites.assembly_states(stored(variants, "variants"), coverage, tuple(samples)), targets), samples


def private_positions(spark: SparkSession, prefix: str, targets: tuple[str, ...], region: tuple[str | None, int | None, int | None] = (None, None, None), **inputs: str | None) -> DataFrame:
    """``<prefix>.intervals.tsv`` and ``<prefix>.summary.tsv``; returns the intervals."""
    sites, samples = sites_of(spark, targets, **inputs)
    if missing := [t for t in targets if t not in samples]:
        raise ValueError(f"targets not in the input: {missing}")
    contig, start, end = region
    inside = F.lit(True) if contig is None else F.col("contig") == contig
    if start is not None:
        inside &= F.col("pos") >= start
    if end is not None:
        inside &= F.col("pos") <= end
    total = sites.count()
    marked = stored(private_sites.verdicts(sites.filter(inside), len(targets)), "verdicts")
    skips = {r["skip"]: r["count"] for r in marked.groupBy("skip").count().collect()}
    runs = kernel.numbered(private_sites.intervals(marked.filter("skip is null")), "n", F.col("contig").asc(), F.col("start").asc(), start=1)
    runs = stored(runs.withColumns({"interval_id": F.format_string("INT%06d", "n"), "chrom": F.col("contig"), "strictness_level": F.col("level"), "targets": F.lit(",".join(targets)), "n_targets_expected": F.lit(len(targets))}), "intervals")
    write_tsv(runs.orderBy("n"), f"{prefix}.intervals.tsv", INTERVALS)
    levels = {r["level"]: r["count"] for r in runs.groupBy("level").count().collect()}
    classes = {r["classification"]: r["count"] for r in runs.groupBy("classification").count().collect()}
    bp = runs.agg(F.coalesce(F.sum("span_bp"), F.lit(0)).alias("bp")).first()["bp"]
    rows = [*((k, v) for k, v in inputs.items() if v), ("targets", ",".join(targets)), ("all_samples", ",".join(samples)), ("n_targets", len(targets)), ("n_nontargets", len(samples) - len(targets)), ("region", contig or ""), ("window_start", start or ""), ("window_end", end or "")]
    rows += [("total_sites", total), ("sites_in_window", sum(skips.values())), *((f"sites_skipped_{k}", skips.get(k, 0)) for k in private_sites.SKIPS), ("qualifying_sites", skips.get(None, 0)), ("qualifying_intervals", sum(levels.values())), ("qualifying_interval_bp_total", bp)]
    rows += [(f"level_{k}_{name}", levels.get(k, 0)) for k, name in enumerate(private_sites.LEVELS, 1)] + [(f"class_{c}", classes.get(c, 0)) for c in ("snp", "indel", "mixed")]
    write_tsv(spark.createDataFrame([(k, str(v)) for k, v in rows], "metric string, value string").coalesce(1), f"{prefix}.summary.tsv")
    return runs
