"""Gene annotation of loci by range joins with class precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladespark.operators.intervals import best, nearest, range_join
from cladespark.operators.scaffold import dense

CLASSES = ("CDS", "UTR", "exon", "intronic", "intergenic")


def _left(loci: DataFrame) -> DataFrame:
    return loci.select(F.col("ord").alias("a_ord"), F.col("contig").alias("a_contig"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))


def _right(features: DataFrame, *more: Column) -> DataFrame:
    return features.select(F.col("contig").alias("b_contig"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), *more)


def annotate(loci: DataFrame, genes: DataFrame, parts: DataFrame, aliases: DataFrame | None = None, width: int = 16_384) -> DataFrame:
    """``loci`` with annotation_class and the leftmost overlapping gene.

    A locus that meets no gene is intergenic; else it is CDS, UTR, exon or
    intronic by the parts of any gene on the contig that it meets. One range
    join finds genes and another all parts at once.
    """
    rows = loci
    if aliases is not None:
        rows = rows.join(aliases, rows["contig"] == aliases["alias_from"], "left").withColumn("_contig", F.coalesce("alias_to", "contig")).drop("alias_from", "alias_to")
    else:
        rows = rows.withColumn("_contig", F.col("contig"))
    left = rows.select(F.col("ord").alias("a_ord"), F.col("_contig").alias("a_contig"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    gene = range_join(left, _right(genes, F.col("gene_id"), F.col("strand").alias("gene_strand"), F.col("ord").alias("g_ord")), width)
    gene = best(gene, ["a_ord"], "b_start", "g_ord").select("a_ord", "gene_id", "gene_strand", F.col("b_start").alias("gene_start"), F.col("b_end").alias("gene_end"))
    kind = F.when(F.col("type") == "CDS", 3).when(F.col("type").contains("UTR"), 2).when(F.col("type") == "exon", 1).otherwise(0)
    part = range_join(left, _right(parts, kind.alias("kind")), width).groupBy("a_ord").agg(F.max("kind").alias("kind"))
    out = rows.join(gene, rows["ord"] == gene["a_ord"], "left").drop("a_ord").join(part, F.col("ord") == part["a_ord"], "left").drop("a_ord")
    name = F.when(F.col("gene_start").isNull(), "intergenic").when(F.col("kind") == 3, "CDS").when(F.col("kind") == 2, "UTR").when(F.col("kind") == 1, "exon").otherwise("intronic")
    return out.withColumn("annotation_class", name).drop("kind", "_contig")


def annotation_summary(annotated: DataFrame) -> DataFrame:
    got = annotated.groupBy("annotation_class").agg(F.count("*").alias("n_loci"))
    total = annotated.select(F.count("*").alias("_total"))
    out = dense(got, {"annotation_class": list(CLASSES)}, {"n_loci": 0}).crossJoin(F.broadcast(total))  # one row
    return out.select("annotation_class", "n_loci", F.when(F.col("_total") > 0, 100 * F.col("n_loci") / F.col("_total")).otherwise(0.0).alias("pct_total"))


def nearest_gene(loci: DataFrame, genes: DataFrame) -> DataFrame:
    """The nearest gene on the contig, however far, ties to the least (start, end, name); closed 1-based distance, 0 inside."""
    near = nearest(_left(loci), _right(genes, F.col("gene_id")), "gene_id")
    return loci.join(near.withColumnRenamed("a_ord", "ord"), "ord", "left")


def feature_counts(features: DataFrame, sites: DataFrame, width: int = 16_384) -> DataFrame:
    """Variants by display type within each feature."""
    left = features.select(F.col("ord").alias("a_ord"), F.col("contig").alias("a_contig"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    pairs = range_join(left, _right(sites, F.col("display_type")), width)
    n = lambda *names: F.count_if(F.col("display_type").isin(*names))
    got = pairs.groupBy(F.col("a_ord").alias("ord")).agg(n("SNP").alias("snp_n"), n("INDEL", "complex").alias("indel_n"), n("SV-like").alias("sv_n"))
    return features.join(got, "ord", "left").na.fill(0, ["snp_n", "indel_n", "sv_n"])
