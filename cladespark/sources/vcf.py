"""VCF records as a DataFrame; genotypes as nested arrays in header order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.sources.text import head_lines, in_region, lines, parse_region


def header(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Sample names and contig names, in file order; only the header is read."""
    rows = head_lines(spark, path, lambda x: x.startswith("#"))
    samples = next((r.split("\t")[9:] for r in rows if r.startswith("#CHROM")), [])
    contigs = [r.split("ID=", 1)[1].split(",")[0].split(">")[0] for r in rows if r.startswith("##contig=<") and "ID=" in r]
    return samples, contigs


def genotype(text: Column) -> Column:
    """Allele numbers of a GT text; '.' gives null elements."""
    return F.transform(F.split(text, "[/|]"), lambda a: a.try_cast("int"))


def require_index(spark: SparkSession, path: str) -> None:
    """An error unless a .tbi or .csi lies beside the file. Spark needs no index; this is for pipelines that promise one."""
    jvm = spark._jvm
    for suffix in (".tbi", ".csi"):
        place = jvm.org.apache.hadoop.fs.Path(path + suffix)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return
    raise FileNotFoundError(f"no index beside {path}")


def read_vcf(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    """(contig, pos, start, end, ref, alts, qual, filters, gts, rec_ord): one row per record, gts one array per header sample."""
    f = F.split("line", "\t")
    rows = lines(spark, path).filter(~F.col("line").startswith("#") & (F.trim("line") != "")).select("rec_ord", f.alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    gt_at = F.array_position(F.split(at(8), ":"), "GT") - 1
    rows = rows.withColumn("gt_at", gt_at.cast("int"))
    ref = at(3)
    # a missing ALT ('.') is no ALT at all; FILTER '.' has no filters
    alts = F.when(at(4) == ".", F.lit(None).cast("array<string>")).otherwise(F.split(at(4), ","))
    filters = F.when(at(6) == ".", F.array().cast("array<string>")).otherwise(F.split(at(6), ";"))
    gts = F.transform(F.slice("f", 10, 1_000_000), lambda s: F.when(F.col("gt_at") >= 0, genotype(F.get(F.split(s, ":"), F.col("gt_at")))))
    pos = at(1).try_cast("long")  # a pushed-down filter may meet header lines
    out = rows.select(at(0).alias("contig"), pos.alias("pos"), (pos - 1).alias("start"), (pos - 1 + F.length(ref)).alias("end"), ref.alias("ref"), alts.alias("alts"), at(5).try_cast("double").alias("qual"), filters.alias("filters"), gts.alias("gts"), "rec_ord")
    return out.filter(in_region(F.col("contig"), F.col("start"), F.col("end"), parse_region(region)))


def variant_type(ref: Column, alt: Column) -> Column:
    return F.when(alt.startswith("<"), "sv").when((F.length(ref) == 1) & (F.length(alt) == 1), "snp").otherwise("indel")


def record_type(ref: Column, alts: Column) -> Column:
    """sv if any ALT is symbolic or a breakend, snp if all alleles are one letter, else indel (also without ALT)."""
    own = F.coalesce(alts, F.array().cast("array<string>"))
    symbolic = F.exists(own, lambda a: a.startswith("<") | a.contains("[") | a.contains("]"))
    single = (F.size(own) > 0) & (F.length(ref) == 1) & F.forall(own, lambda a: F.length(a) == 1)
    return F.when(symbolic, "sv").when(single, "snp").otherwise("indel")


def display_type(ref: Column, alts: Column, sv_length: int = 50) -> Column:
    """SNP, SV-like (symbolic or long), INDEL or complex, for a record."""
    longest = F.greatest(F.length(ref), F.array_max(F.transform(alts, F.length)))
    symbolic = F.exists(alts, lambda a: a.rlike(r"[<\[\]]"))
    same = F.forall(alts, lambda a: F.length(a) == F.length(ref))
    return F.when(symbolic | (longest >= sv_length), "SV-like").when(longest == 1, "SNP").when(~same, "INDEL").otherwise("complex")


def allele_key(contig: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """contig:pos:ref:alt, alleles cut to 20 letters and '...'."""
    short = lambda a: F.when(F.length(a) > 20, F.concat(F.left(a, F.lit(20)), F.lit("..."))).otherwise(a)
    return F.concat_ws(":", contig, pos, short(ref), short(alt))


def genotype_text(gt: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(gt, lambda a: F.coalesce(a.cast("string"), F.lit("."))), "/"), F.lit("./."))


def genotype_state(gt: Column) -> Column:
    """no_call, hom_ref, hom_alt, het or alt_mixed."""
    lost = gt.isNull() | F.exists(gt, lambda a: a.isNull())
    kinds = F.array_distinct(gt)
    return F.when(lost, "no_call").when(F.forall(gt, lambda a: a == 0), "hom_ref").when(F.size(kinds) == 1, "hom_alt").when(F.array_contains(kinds, 0), "het").otherwise("alt_mixed")
