"""GFF3 features, plain for annotation and URL-decoded for gene models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.sources.text import lines

PARTS = ("CDS", "exon", "five_prime_UTR", "three_prime_UTR", "UTR")


def _attributes(text: Column, decode: bool) -> Column:
    plain = (lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))) if decode else (lambda c: c)
    items = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("=")))
    # only the first = separates; a repeated key keeps its last value
    entries = F.transform(items, lambda x: F.struct(plain(F.trim(F.substring_index(x, "=", 1))).alias("key"), plain(F.trim(F.substring(x, F.length(F.substring_index(x, "=", 1)) + 2, F.length(x)))).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.lit(100_000)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def read_gff(spark: SparkSession, path: str, types: tuple[str, ...] | None = None, decode: bool = False, strict: bool = False) -> DataFrame:
    """(contig, type, start, end, strand, attrs, gene_id, ord): 0-based half-open; short rows and rows with bad numbers are left out."""
    f = F.split("line", "\t")
    rows = lines(spark, path).filter(~F.col("line").startswith("#")).select(f.alias("f"), F.col("rec_ord").alias("ord"))
    rows = rows.filter(F.size("f") == 9 if strict else F.size("f") >= 9)
    at = lambda i: F.get("f", F.lit(i))
    rows = rows.select(at(0).alias("contig"), at(2).alias("type"), (at(3).try_cast("long") - 1).alias("start"), at(4).try_cast("long").alias("end"), at(6).alias("strand"), _attributes(at(8), decode).alias("attrs"), "ord").filter("start is not null and end is not null")
    if types:
        rows = rows.filter(F.col("type").isin(*types))
    return rows.withColumn("gene_id", F.coalesce(F.try_element_at("attrs", F.lit("Name")), F.try_element_at("attrs", F.lit("ID")), F.lit("")))


def genes_and_parts(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    return features.filter("type = 'gene'"), features.filter(F.col("type").isin(*PARTS))


def read_aliases(spark: SparkSession, path: str, inverted: bool = True) -> DataFrame:
    """(alias_from, alias_to) from two columns; later lines win. By default the second column is what the loci use."""
    f = F.split("line", "\t")
    rows = lines(spark, path).filter(~F.col("line").startswith("#")).select(f.alias("f"), "rec_ord").filter("size(f) >= 2")
    a, b = (1, 0) if inverted else (0, 1)
    rows = rows.select(F.trim(F.col("f")[a]).alias("alias_from"), F.trim(F.col("f")[b]).alias("alias_to"), "rec_ord")
    return rows.groupBy("alias_from").agg(F.max_by("alias_to", "rec_ord").alias("alias_to"))
