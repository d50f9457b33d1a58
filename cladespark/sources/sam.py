"""Aligned reads from SAM text, and per-locus pileups.

Compressed BAM has no reader here (the box has no decoder); convert with any
tool to SAM, or to Parquet with the same columns.
"""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.operators.intervals import range_join
from cladespark.sources.text import head_lines, lines

UNMAPPED, SECONDARY, SUPPLEMENTARY = 0x4, 0x100, 0x800


def sample_name(spark: SparkSession, path: str) -> str | None:
    """SM of the first read group; only the header is read."""
    group = next((x for x in head_lines(spark, path, lambda x: x.startswith("@")) if x.startswith("@RG")), "")
    return next((f[3:] for f in group.split("\t") if f.startswith("SM:") and len(f) > 3), None)


def read_manifest(path: str) -> list[tuple[str, str]]:
    """(path, sample) rows of a manifest: a header with bam_path and sample_id, lines with # skipped."""
    with open(path, encoding="utf-8", newline="") as f:
        rows = csv.DictReader((x for x in f if not x.startswith("#")), delimiter="\t")
        names = rows.fieldnames or ()
        if missing := [c for c in ("bam_path", "sample_id") if c not in names]:
            raise ValueError(f"{path} lacks the column {missing[0]}")
        return [(r["bam_path"], r["sample_id"]) for r in rows]


def sample_pairs(spark: SparkSession, paths: list[str] | None, manifest: str | None) -> list[tuple[str, str]]:
    """(path, sample) of all read files: a manifest comes before paths; a file's sample is its first read group's, else its name."""
    if manifest:
        return read_manifest(manifest)
    return [(p, sample_name(spark, p) or os.path.splitext(os.path.basename(p))[0]) for p in paths or ()]


def read_sam(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """(sample, read, contig, start, mapq, flag, cigar, seq, qual), 0-based start."""
    rows = lines(spark, path).filter(~F.col("line").startswith("@")).select(F.split("line", "\t").alias("f"), "rec_ord")
    at = lambda i: F.get("f", F.lit(i))
    return rows.select(F.lit(sample).alias("sample"), F.col("rec_ord").alias("read"), at(2).alias("contig"), (at(3).cast("long") - 1).alias("start"), at(4).cast("int").alias("mapq"), at(1).cast("int").alias("flag"), at(5).alias("cigar"), at(9).alias("seq"), at(10).alias("qual"))


def aligned_blocks(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    """One row per CIGAR operation that consumes the reference: (sample, read, contig, op, start, end, seq, qual) with the matching letters."""
    use = reads.filter((F.col("flag").bitwiseAND(UNMAPPED | SECONDARY | SUPPLEMENTARY) == 0) & (F.col("mapq") >= min_mapq) & (F.col("cigar") != "*"))
    ops = F.transform(F.regexp_extract_all("cigar", F.lit("(\\d+[MIDNSHP=X])"), 1), lambda x: F.struct(F.regexp_extract(x, "^([0-9]+)", 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    # running places on the reference and on the read, carried along the operations
    zero = F.struct(F.col("start").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<op:string,r:bigint,q:bigint,n:int>>").alias("out"))
    on_ref = lambda o: o["op"].isin("M", "D", "N", "=", "X")
    on_read = lambda o: o["op"].isin("M", "I", "S", "=", "X")

    def step(acc, o):
        made = F.when(on_ref(o), F.concat(acc["out"], F.array(F.struct(o["op"].alias("op"), acc["r"].alias("r"), acc["q"].alias("q"), o["n"].alias("n"))))).otherwise(acc["out"])
        return F.struct((acc["r"] + F.when(on_ref(o), o["n"]).otherwise(0)).cast("long").alias("r"), (acc["q"] + F.when(on_read(o), o["n"]).otherwise(0)).cast("long").alias("q"), made.alias("out"))

    rows = use.select("sample", "read", "contig", "seq", "qual", F.inline(F.aggregate(ops, zero, step)["out"]))
    letters = lambda c: F.when(F.col("op").isin("M", "=", "X"), F.substring(F.col(c), F.col("q").cast("int") + 1, F.col("n")))
    return rows.select("sample", "read", "contig", "op", F.col("r").alias("start"), (F.col("r") + F.col("n")).alias("end"), letters("seq").alias("seq"), letters("qual").alias("qual"))


def allele_counts(loci: DataFrame, blocks: DataFrame, samples: list[str], min_baseq: int = 20, width: int = 1024) -> DataFrame:
    """(ord, sample, ref_n, alt_n, depth): SNP loci by base; deletions and skips count as neither; other loci by mean depth. Every pair of locus and sample has a row."""
    left = loci.select(F.col("ord").alias("a_ord"), F.col("contig").alias("a_contig"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), "ref", "alt", "variant_type")
    right = blocks.select("sample", "op", F.col("contig").alias("b_contig"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), "seq", "qual")
    met = range_join(left, right, width)
    i = (F.col("a_start") - F.col("b_start") + 1).cast("int")
    base, q = F.upper(F.substring("seq", i, F.lit(1))), F.ascii(F.substring("qual", i, F.lit(1))) - 33
    is_snp, gap = F.col("variant_type") == "snp", F.col("op").isin("D", "N")
    good = is_snp & ~gap & ((F.col("qual") == "*") | (q >= min_baseq))
    span = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    got = met.groupBy("a_ord", "sample").agg(
        F.count_if(good & (base == F.col("ref"))).alias("ref_n"), F.count_if(good & (base == F.col("alt"))).alias("alt_n"), F.count_if(good | (is_snp & gap)).alias("snp_depth"),
        F.sum(F.when(~gap, span).otherwise(0)).alias("bases"), F.max(F.col("a_end") - F.col("a_start")).alias("len"), F.max(is_snp.cast("int")).alias("snp"),
    )
    depth = F.when(F.col("snp") == 1, F.col("snp_depth")).otherwise(F.floor(F.col("bases") / F.greatest("len", F.lit(1))))
    got = got.select("a_ord", "sample", F.when(F.col("snp") == 1, F.col("ref_n")).otherwise(depth).alias("ref_n"), "alt_n", depth.alias("depth"))
    frame = loci.select("ord", "variant_type", F.explode(F.array(*[F.lit(s) for s in samples])).alias("sample"))
    return frame.join(got.withColumnRenamed("a_ord", "ord"), ["ord", "sample"], "left").na.fill(0, ["ref_n", "alt_n", "depth"])


def position_depth(blocks: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """(sample, pos, depth) for every position of [start, end) and every sample of ``blocks``, zeros included; deletions and skips don't count."""
    own = blocks.filter((F.col("contig") == contig) & F.col("op").isin("M", "=", "X") & (F.col("start") < end) & (F.col("end") > start))
    low, high = F.greatest("start", F.lit(start)), F.least("end", F.lit(end)) - 1
    got = own.select("sample", F.explode(F.sequence(low, high)).alias("pos")).groupBy("sample", "pos").agg(F.count("*").alias("depth"))
    frame = blocks.select("sample").distinct().withColumn("pos", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end - 1).cast("long"))))
    return frame.join(got, ["sample", "pos"], "left").na.fill(0, ["depth"])


def read_evidence(counts: DataFrame, targets: tuple[str, ...], min_depth: int = 8, min_fraction: float = 0.2, min_alt: int = 2) -> DataFrame:
    """Adds allele_fraction (four decimals, as the threshold sees it), evidence_class and its value."""
    from cladespark.functions.rounding import half_even

    fraction = half_even(F.when(F.col("depth") > 0, F.col("alt_n") / F.col("depth")).otherwise(0.0), 4)
    rows = counts.withColumn("allele_fraction", fraction)
    has = (F.col("alt_n") >= min_alt) & (F.col("allele_fraction") >= min_fraction)
    target = F.col("sample").isin(*targets)
    kind = F.when((F.col("depth") < min_depth) | (F.col("variant_type") != "snp"), "uninformative").when(target, F.when(has, "support").otherwise("ambiguous")).otherwise(F.when(has, "contradiction").otherwise("absence"))
    value = F.when(kind == "support", 1.0).when(kind == "ambiguous", 0.3).when(kind == "contradiction", -1.0).when(kind == "absence", 1.0)
    return rows.withColumns({"evidence_class": kind, "evidence_value": value})


def locus_support(evidence: DataFrame) -> DataFrame:
    """(ord, support): mean of the informative values per locus, at most 1, with six decimals; 0 without any."""
    from cladespark.functions.rounding import half_even

    return evidence.groupBy("ord").agg(half_even(F.least(F.coalesce(F.avg("evidence_value"), F.lit(0.0)), F.lit(1.0)), 6).alias("support"))
