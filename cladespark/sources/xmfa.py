"""XMFA alignment blocks and their columns anchored on a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_xmfa(spark: SparkSession, path: str) -> DataFrame:
    """(block, sample, start, end, strand, seq): entries of the blocks that lines beginning with '=' end; coordinates 1-based closed as in the file."""
    blocks = spark.read.text(path, lineSep="\n=").select(F.monotonically_increasing_id().alias("block"), F.col("value").alias("text"))
    entries = blocks.select("block", F.explode(F.split("text", "(?m)^>")).alias("e")).filter(F.col("e").rlike(r"^\s*\S+:\d+-\d+"))
    head = lambda i: F.regexp_extract("e", r"^\s*(\S+):(\d+)-(\d+)\s*([+-])\s*(\S*)", i)
    name = F.when(head(5) != "", F.element_at(F.split(head(5), "/"), -1)).otherwise(head(1))
    seq = F.upper(F.replace(F.regexp_replace(F.regexp_replace("e", r"^[^\n]*\n", ""), r"\s", ""), F.lit("."), F.lit("-")))
    return entries.select("block", F.split(name, r"\.")[0].alias("sample"), head(2).cast("long").alias("start"), head(3).cast("long").alias("end"), head(4).alias("strand"), seq.alias("seq"))


def reference_states(entries: DataFrame, reference: str, contig: str = "reference", offset: int = 0) -> DataFrame:
    """(contig, pos, ref, sample, state): columns in which the reference has a base, with its position on either strand."""
    bases = F.filter(F.split("seq", ""), lambda c: c != "")
    ref = entries.filter(F.col("sample") == reference)
    cols = ref.select("block", "strand", F.least("start", "end").alias("lo"), F.greatest("start", "end").alias("hi"), "seq", F.posexplode(bases).alias("col", "ref"))
    before = F.length(F.replace(F.substring(F.col("seq"), F.lit(1), F.col("col")), F.lit("-"), F.lit("")))
    pos = F.when(F.col("strand") == "-", F.col("hi") - before).otherwise(F.col("lo") + before)
    cols = cols.filter(F.col("ref").isin("A", "C", "G", "T")).select("block", "col", "ref", (pos + offset).alias("pos"))
    states = entries.select("block", "sample", F.posexplode(bases).alias("col", "state")).filter(F.col("state").isin("A", "C", "G", "T", "-"))
    return states.join(cols, ["block", "col"]).select(F.lit(contig).alias("contig"), "pos", "ref", "sample", "state")
