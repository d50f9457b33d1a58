"""Assemblies aligned to a reference: differences and covered intervals from SAM text and FASTA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.operators.intervals import range_join
from cladespark.sources import sam

#: Bases of a piece of the reference.
PIECE = 4096


def read_fasta(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(contig, start, end, seq): upper-case sequences in pieces, 0-based half-open. A record of the text source is a whole sequence."""
    rows = spark.read.text(path, lineSep=">").filter(F.trim("value") != "")
    rows = rows.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("contig"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")).alias("seq"))
    cuts = rows.filter(F.length("seq") > 0).select("contig", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / piece).cast("int"))).alias("k"))
    cuts = cuts.select("contig", (F.col("k") * piece).cast("long").alias("start"), F.substring(F.col("seq"), F.col("k") * piece + 1, F.lit(piece)).alias("seq"))
    return cuts.withColumn("end", F.col("start") + F.length("seq")).select("contig", "start", "end", "seq")


def differences(reads: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variants, coverage) of aligned assemblies: contig, pos (1-based), sample, ref, alt ('-' deleted); and sample, contig, start, end (1-based closed).

    Primary alignments of any quality count. Where several say something about a
    place, the one that starts first does (then the first in the file). Insertions have no place
    on the reference; letters other than A, C, G and T say nothing.
    """
    blocks = sam.aligned_blocks(reads, min_mapq=0).filter(F.col("op").isin("M", "=", "X", "D"))
    spans = sam.aligned_blocks(reads, min_mapq=0).groupBy("sample", "read", "contig").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    coverage = spans.select("sample", "contig", (F.col("a") + 1).alias("start"), F.col("b").alias("end"))
    own = blocks.join(spans, ["sample", "read", "contig"])
    left = own.select("sample", "read", "a", "op", "seq", F.col("contig").alias("a_contig"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    right = reference.select(F.col("seq").alias("ref_seq"), F.col("contig").alias("b_contig"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    met = range_join(left, right, PIECE).withColumns({"lo": F.greatest("a_start", "b_start"), "hi": F.least("a_end", "b_end")})
    part = lambda c, at: F.substring(F.col(c), (F.col("lo") - F.col(at) + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    alt = F.when(F.col("op") == "D", F.repeat(F.lit("-"), (F.col("hi") - F.col("lo")).cast("int"))).otherwise(F.upper(part("seq", "a_start")))
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    pairs = F.arrays_zip(letters(part("ref_seq", "b_start")).alias("ref"), letters(alt).alias("alt"))
    each = met.select("sample", "read", "a", F.col("a_contig").alias("contig"), "lo", F.posexplode(pairs).alias("i", "p")).select("sample", "read", "a", "contig", (F.col("lo") + F.col("i") + 1).alias("pos"), "p.ref", "p.alt")
    each = each.filter(F.col("ref").isin(*"ACGT") & F.col("alt").isin(*"ACGT-") & (F.col("ref") != F.col("alt")))
    first = each.groupBy("sample", "contig", "pos").agg(F.min(F.struct("a", "read", "ref", "alt")).alias("m"))
    return first.select("contig", "pos", "sample", "m.ref", "m.alt"), coverage
