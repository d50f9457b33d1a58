"""Report, plot and dashboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladespark.functions.rounding import half_even
from cladespark.operators.scaffold import dense

#: Classes of strictness in output order (fixed names).
STRICTNESS = ("strict_complete", "strict_target_missing", "strict_offtarget_missing", "strict_both_missing", "relaxed_threshold")


def support_summary(evidence: DataFrame) -> DataFrame:
    """Records per source and class, with their share within the source; the window runs over the aggregate only."""
    got = evidence.groupBy("source_type", "evidence_class").agg(F.count("*").alias("n_records"))
    return got.withColumn("share", F.col("n_records") / F.sum("n_records").over(Window.partitionBy("source_type")))


def score_histogram(hits: DataFrame) -> DataFrame:
    """Hits per class and score bin between 0 and the greatest score + 0.05, in at most 29 bins and at most one more than hits; the last bin is closed."""
    one = hits.agg((F.max("final_score") + 0.05).alias("_top"), (F.least(F.count("*") + 2, F.lit(30)) - 1).alias("_bins"))  # one row
    at = F.least(F.floor(F.col("final_score") / (F.col("_top") / F.col("_bins"))), F.col("_bins") - 1).cast("long")
    return hits.crossJoin(F.broadcast(one)).groupBy("strictness_class", at.alias("bin")).agg(F.count("*").alias("n"))


def density_bins(hits: DataFrame, width: int) -> DataFrame:
    """Hits per contig and bin of ``width`` bases from the contig's first hit to its last, empty bins included."""
    extent = hits.groupBy("contig").agg(F.min("start").alias("_lo"), F.max("start").alias("_hi"))
    frame = extent.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_hi") - F.col("_lo")) / width).cast("long"))).alias("bin"))
    got = hits.join(extent, "contig").groupBy("contig", F.floor((F.col("start") - F.col("_lo")) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return frame.join(got, ["contig", "bin"], "left").na.fill(0)


def candidate_features(features: DataFrame, limit: int) -> DataFrame:
    """Features by variant burden (SNP 1, indel or complex 2, SV 4), with optional bonus column; ties by start, part and id."""
    score = F.col("snp_n") + 2 * F.col("indel_n") + 4 * F.col("sv_n")
    if "bonus" in features.columns:
        score = score + F.col("bonus")
    order = [F.col("rank_score").desc(), "start", *(["part"] if "part" in features.columns else []), "gene_id"]
    rows = features.withColumn("rank_score", score).filter("rank_score > 0").orderBy(*order).limit(limit)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_with_other(counts: DataFrame, label: str, n: int) -> DataFrame:
    """The n most frequent labels and one row 'other' for the rest; ``counts`` has the label and count."""
    w = Window.orderBy(F.col("count").desc(), label)
    ranked = counts.withColumn("_r", F.row_number().over(w))  # counts are per label, not per row
    return ranked.groupBy(F.when(F.col("_r") <= n, F.col(label)).otherwise("other").alias(label)).agg(F.sum("count").alias("count"))


def contig_summary(windows: DataFrame) -> DataFrame:
    """Windows, variants and means per contig; undefined rates count as 0."""
    zero = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(f"mean_{c}")
    return windows.groupBy("contig").agg(F.count("*").alias("n_windows"), F.sum("n_variants").alias("n_variants"), F.min("start").alias("start"), F.max("end").alias("end"), zero("target_mean_missing_rate"), zero("offtarget_mean_missing_rate"))


def run_counters(hits: DataFrame, regions: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row of totals for a dashboard."""
    h = hits.agg(F.count("*").alias("n_hits"), F.max("final_score").alias("best_score"), F.min("final_score").alias("least_score"))
    return h.crossJoin(regions.agg(F.count("*").alias("n_regions"))).crossJoin(evidence.agg(F.count("*").alias("n_evidence")))  # three single rows


def strictness_summary(hits: DataFrame) -> DataFrame:
    """(strictness_class, n_loci, pct_hits): the five classes in their order, zeros included, then any others by name; shares with one decimal."""
    got = hits.groupBy("strictness_class").agg(F.count("*").alias("n_loci"))
    full = dense(got, {"strictness_class": list(STRICTNESS)}, {"n_loci": 0}).unionByName(got.filter(~F.col("strictness_class").isin(*STRICTNESS)))
    total = F.sum("n_loci").over(Window.partitionBy(F.lit(1)))  # over a handful of summary rows
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STRICTNESS)), F.col("strictness_class")), F.lit(0).cast("long")), F.lit(len(STRICTNESS) + 1))
    return full.withColumns({"pct_hits": F.when(total > 0, half_even(100 * F.col("n_loci") / total, 1)).otherwise(0.0), "place": place})


def contradiction_summary(qc: DataFrame | None, compared: DataFrame | None) -> list[tuple[str, str, str]]:
    """(metric, value, description) rows from qc and compare tables; those not given are left out."""
    out = []
    if qc is not None:
        got = qc.filter("metric = 'alleles_contradicted'").select("value").limit(1).collect()
        out += [("alleles_contradicted", got[0]["value"], "alleles that off-targets carry too")] if got else []
    if compared is not None:
        out.append(("compare_contradicted_loci", str(compared.filter("match_class = 'contradicted'").count()), "loci that compare classes as contradicted"))
    return out


def run_summary(hits: DataFrame, regions: DataFrame | None = None, qc: DataFrame | None = None, run: dict | None = None, project: str = "") -> list[tuple[str, str, str]]:
    """(metric, value, description) rows of one run; the best hit is the first with the greatest score."""
    out = [("project_name", project or str((run or {}).get("project_name", "")), "name of the project"), ("n_hits", str(hits.count()), "rows of hits")]
    if regions is not None:
        out.append(("n_regions", str(regions.count()), "rows of regions"))
    best = hits.orderBy(F.coalesce(F.col("final_score").try_cast("double"), F.lit(0.0)).desc(), "ord").select("locus_id", F.col("final_score").cast("string").alias("s")).limit(1).collect()
    if best:
        out += [("top_locus_id", best[0]["locus_id"], "hit with the greatest score"), ("top_final_score", best[0]["s"], "its score")]
    if qc is not None:
        values = {r["metric"]: r["value"] for r in qc.filter(F.col("metric").isin("records_evaluated", "alleles_passed", "alleles_contradicted")).collect()}
        out += [(k, values[k], "from qc") for k in ("records_evaluated", "alleles_passed", "alleles_contradicted") if k in values]
    out += [(k, str(run[k]), "from the run") for k in ("start_time", "end_time", "version") if run and run.get(k) is not None]
    return out


def region_bins(sites: DataFrame, start: int, end: int, width: int = 50_000) -> DataFrame:
    """(bin, start, end, target, background, all_same): sites of a region by pattern class in bins of ``width``, empty ones included; 1-based closed."""
    bins = (end - start) // width + 1
    at = F.least(F.greatest(F.floor((F.col("pos") - start) / width), F.lit(0)), F.lit(bins - 1)).cast("long").alias("bin")
    n = lambda name: F.count_if(F.col("pattern_class") == name)
    got = sites.filter(F.col("pos").between(start, end)).groupBy(at).agg(n("target_private").alias("target"), n("background_like").alias("background"), n("all_same").alias("all_same"))
    frame = sites.sparkSession.range(bins).select(F.col("id").alias("bin"), (start + F.col("id") * width).alias("start"), F.least(F.lit(end).cast("long"), start + (F.col("id") + 1) * width - 1).alias("end"))
    return frame.join(got, "bin", "left").na.fill(0)
