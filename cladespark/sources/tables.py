"""TSV tables of this engine: all text on read, then cast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HITS = "locus_id contig start end variant_type allele_key target_support_n target_total_n offtarget_support_n offtarget_total_n target_missing_n offtarget_missing_n strictness_class discovery_score support_score penalty_score final_score".split()
REGIONS = "region_id contig start end n_loci variant_types dominant_strictness_class target_consistency offtarget_exclusion final_score".split()
EVIDENCE = "locus_id source_type sample_id evidence_class metric_name metric_value details".split()
SAMPLE_SUPPORT = "locus_id sample_id cohort_role genotype allele_supported depth allele_fraction evidence_class".split()
QC = "metric value description".split()


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string; ``ord`` keeps the file's order."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    return rows.withColumn("ord", F.monotonically_increasing_id())


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """hits with typed coordinates and scores; a value that can't be read is an error."""
    rows = read_tsv(spark, path)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("start", "end", *[x for x in HITS if x.endswith("_n")]) if c in rows.columns} | {c: F.col(c).cast("double") for c in HITS if c.endswith("_score") and c in rows.columns})


def lenient(column: str, kind: str = "double"):
    """NA, blanks and unreadable numbers as 0, as dashboards count them."""
    return F.coalesce(F.nanvl(F.col(column).try_cast("double"), F.lit(0.0)), F.lit(0.0)).cast(kind)


def source_label(hits: DataFrame, explicit: str | None = None) -> str:
    """The label given, else gfa if the first id starts with GPX, else vcf."""
    if explicit:
        return explicit
    first = hits.orderBy("ord").select("locus_id").limit(1).collect()
    return "gfa" if first and (first[0][0] or "").startswith("GPX") else "vcf"
