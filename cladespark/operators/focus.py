"""Focus views of one region: donor patterns, gene models, candidates and groups. Coordinates are 1-based closed here."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladespark.operators.intervals import best, gaps_between, union_of_intervals
from cladespark.operators.landscape import missing
from cladespark.sources.vcf import display_type, genotype_state, genotype_text


def parse_focus(text: str) -> tuple[str, int, int]:
    """contig:start-end, commas allowed; anything else is an error."""
    m = re.fullmatch(r"\s*([^:\s]+):([\d,]+)-([\d,]+)\s*", text)
    if not m:
        raise ValueError(f"not a region: {text!r}")
    start, end = int(m[2].replace(",", "")), int(m[3].replace(",", ""))
    if start < 1 or end < start:
        raise ValueError(f"not a region: {text!r}")
    return m[1], start, end


def focus_sites(records: DataFrame, samples: list[str], derived: str, donor: str, off_target: str, sv_length: int = 50, all_called: bool = True) -> DataFrame:
    """Per record: texts and states of three samples, ALT indices shared by derived and donor only, and the pattern class."""
    gt = {name: F.get("gts", F.lit(samples.index(s))) for name, s in (("derived", derived), ("donor", donor), ("off_target", off_target))}
    rows = records.withColumns({f"_{n}": g for n, g in gt.items()})
    if all_called:
        rows = rows.filter(reduce(lambda a, b: a & b, [~missing(F.col(f"_{n}")) for n in gt]))
    alts = lambda n: F.array_distinct(F.filter(F.coalesce(F.col(f"_{n}"), F.array().cast("array<int>")), lambda a: a > 0))
    only = F.array_except(alts("donor"), alts("off_target"))
    rows = rows.withColumns({f"{n}_gt": genotype_text(F.col(f"_{n}")) for n in gt} | {f"{n}_state": genotype_state(F.col(f"_{n}")) for n in gt} | {"donor_private_alts": only, "shared_private_alts": F.array_intersect(alts("derived"), only), "display_type": display_type(F.col("ref"), F.col("alts"), sv_length)})
    d, o, x = F.col("derived_gt"), F.col("donor_gt"), F.col("off_target_gt")
    pattern = F.when((d == o) & (d == x), "all_same").when((d == o) & (d != x), "target_private").when((d == x) & (d != o), "background_like").otherwise("other")
    return rows.withColumn("pattern_class", pattern).drop("_derived", "_donor", "_off_target", "gts")


def gene_models(features: DataFrame, promoter_bp: int = 2000) -> DataFrame:
    """(gene_id, part, start, end) from rows with gene_id, type, start, end (closed), strand: merged exons and CDS, introns between exons, upstream promoters."""
    parts = []
    for kind in ("exon", "CDS"):
        merged = union_of_intervals(features.filter(F.col("type") == kind), ["gene_id"], gap=1)
        parts.append(merged.withColumn("part", F.lit(kind.lower())))
        if kind == "exon":
            parts.append(gaps_between(merged, ["gene_id"], closed=True).withColumn("part", F.lit("intron")))
    genes = features.filter("type = 'gene'")
    minus = F.col("strand") == "-"
    up = genes.select("gene_id", F.when(minus, F.col("end") + 1).otherwise(F.greatest(F.lit(1), F.col("start") - promoter_bp)).alias("start"), F.when(minus, F.col("end") + promoter_bp).otherwise(F.col("start") - 1).alias("end"))
    parts.append(up.filter("end >= start").withColumn("part", F.lit("promoter")))
    parts.append(genes.select("gene_id", "start", "end").withColumn("part", F.lit("gene")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def clipped(df: DataFrame, low: int, high: int) -> DataFrame:
    """Intervals cut to the focus region; those outside go."""
    return df.withColumns({"start": F.greatest("start", F.lit(low)), "end": F.least("end", F.lit(high))}).filter("start <= end")


def chosen_transcript(transcripts: DataFrame) -> DataFrame:
    """Per gene: the one marked longest, else the longest, else the least id."""
    return best(transcripts, ["gene_id"], F.col("longest").desc(), (F.col("end") - F.col("start")).desc(), "transcript_id")


def functional(features: DataFrame, annotations: DataFrame, keys: tuple[str, ...] = ("gene", "gene_id", "locus", "Name")) -> DataFrame:
    """Left join with a functional table keyed by any of several columns; later rows win; the gene's name is tried before its id."""
    have = [k for k in keys if k in annotations.columns]
    long = annotations.select(F.explode(F.array(*have)).alias("key"), "text", "ord").filter("key is not null and key <> ''")
    one = long.groupBy("key").agg(F.max_by("text", "ord").alias("text"))
    by_name = features.join(one.select(F.col("key").alias("gene_name"), F.col("text").alias("_a")), "gene_name", "left")
    both = by_name.join(one.select(F.col("key").alias("gene_id"), F.col("text").alias("_b")), "gene_id", "left")
    return both.withColumn("functional", F.coalesce("_a", "_b")).drop("_a", "_b")


def candidate_bonus(impact: Column, part: Column, in_category: Column, in_track: Column) -> Column:
    """Impact high 8 or moderate 3, category 2, promoter, exon or CDS 2, further track 1."""
    add = lambda test, n: F.when(test, n).otherwise(0)
    return F.when(F.lower(impact) == "high", 8).when(F.lower(impact) == "moderate", 3).otherwise(0) + add(in_category, 2) + add(part.isin("promoter", "exon", "cds"), 2) + add(in_track, 1)


def candidate_groups(features: DataFrame, keywords: dict[str, tuple[str, ...]], fields: tuple[str, ...]) -> DataFrame:
    """(group, ...) rows: features of each keyword group, by substring in the joined lower-cased fields."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in fields]))
    rows = features.withColumn("_text", text)
    hit = F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains("_text", F.lit(w.lower())) for w in words]), F.lit(name)) for name, words in keywords.items()])
    return rows.withColumn("group", F.explode(F.array_compact(hit))).drop("_text")
