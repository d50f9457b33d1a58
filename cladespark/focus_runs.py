"""Focus pages: sites of three samples in a region, gene models with variant counts, candidates and groups. 1-based closed."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark import dashboards
from cladespark.operators import focus
from cladespark.operators.annotate import feature_counts, nearest_gene
from cladespark.operators.ordering import stored
from cladespark.operators.summaries import region_bins
from cladespark.sinks import write_tsv
from cladespark.sources import gff, tables, vcf

#: Columns of the sites table before those of the samples (fixed names).
SITE_COLUMNS = ("contig", "pos", "end", "ref", "alt", "qual", "filter", "variant_type", "overlapping_gene_names", "nearest_gene_name", "nearest_gene_distance_bp")


def extract_sites(records: DataFrame, samples: list[str], trio: tuple[str, str, str], region: tuple[str, int, int], pass_only: bool = True, all_called: bool = True, variant_type: str = "all", biallelic_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(marked records of the region, counters): the first rule that a record fails is its reason, null if it is kept."""
    if variant_type not in ("all", "snp", "indel", "sv"):
        raise ValueError("variant type must be all, snp, indel or sv")
    if missing := [s for s in trio if s not in samples]:
        raise ValueError(f"samples not in the input: {missing}")
    contig, start, end = region
    rows = records.filter((F.col("contig") == contig) & F.col("pos").between(start, end))
    rows = rows.withColumns({"record_type": vcf.record_type(F.col("ref"), F.col("alts"))} | {f"_s{k}": vcf.genotype_state(F.get("gts", F.lit(samples.index(s)))) for k, s in enumerate(trio)})
    rules = []
    if biallelic_only:
        rules.append((F.coalesce(F.size("alts"), F.lit(0)) != 1, "skipped_biallelic"))
    if pass_only:
        rules.append((~((F.size("filters") == 0) | F.array_contains("filters", "PASS")), "skipped_filter"))
    if variant_type != "all":
        rules.append((F.col("record_type") != variant_type, "skipped_variant_type"))
    if all_called:
        rules.append((reduce(lambda a, b: a | b, [F.col(f"_s{k}") == "no_call" for k in range(3)]), "skipped_missing"))
    reason = F.lit(None).cast("string")
    for test, name in reversed(rules):
        reason = F.when(test, name).otherwise(reason)
    rows = rows.withColumn("reason", reason).drop("_s0", "_s1", "_s2")
    names = ("skipped_filter", "skipped_variant_type", "skipped_missing", "skipped_biallelic")
    counters = rows.agg(F.count("*").alias("records_seen"), F.count_if(F.col("reason").isNull()).alias("records_written"), *[F.count_if(F.col("reason") == n).alias(n) for n in names])
    return rows, counters


def site_table(kept: DataFrame, samples: list[str], trio: tuple[str, str, str], genes: DataFrame | None, sv_length: int) -> DataFrame:
    """One row per kept record, with its genes, the three samples' genotypes, and pattern and display classes."""
    off, derived, donor = trio
    rows = focus.focus_sites(kept.withColumns({"_gts": F.col("gts")}), samples, derived, donor, off, sv_length, all_called=False).withColumnRenamed("_gts", "gts")
    rows = rows.withColumns({"end": F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1, "alt": F.array_join("alts", ","), "filter": F.when(F.size("filters") == 0, "PASS").otherwise(F.array_join("filters", ";")), "variant_type": F.col("record_type"), "start0": F.col("pos") - 1, "ord": F.col("rec_ord")})
    if genes is not None:
        loci = rows.select("ord", "contig", F.col("start0").alias("start"), F.col("end"))
        near = nearest_gene(loci, genes).select("ord", F.col("gene_id").alias("nearest_gene_name"), F.col("distance").alias("nearest_gene_distance_bp"))
        from cladespark.operators.intervals import range_join

        met = range_join(loci.select("ord", F.col("contig").alias("a_contig"), F.col("start").alias("a_start"), F.col("end").alias("a_end")), genes.select(F.col("contig").alias("b_contig"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), "gene_id"))
        over = met.groupBy("ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b_start", "b_end", "gene_id"))), lambda g: g["gene_id"]), ",").alias("overlapping_gene_names"))
        rows = rows.join(near, "ord", "left").join(over, "ord", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("nearest_gene_name", "nearest_gene_distance_bp", "overlapping_gene_names")})
    for name, sample in (("off_target", off), ("derived", derived), ("donor", donor)):
        gt = F.get("gts", F.lit(samples.index(sample)))
        rows = rows.withColumns({f"{sample}_gt": F.col(f"{name}_gt"), f"{sample}_state": F.col(f"{name}_state"), f"{sample}_carries_alt": F.coalesce(F.exists(gt, lambda a: a > 0), F.lit(False)).cast("string")})
    own = [f"{s}_{c}" for s in trio for c in ("gt", "state", "carries_alt")]
    return rows.select(*SITE_COLUMNS, "pattern_class", "display_type", *own, "ord")


def read_sites(spark: SparkSession, path: str, region: tuple[str, int, int], trio: tuple[str, str, str], sv_length: int = 50) -> DataFrame:
    """A sites table's rows of the region by position, with pattern and display classes from its texts; missing columns are an error."""
    rows = tables.read_tsv(spark, path)
    if missing := [c for c in ("contig", "pos", "ref", "alt", *[f"{s}_gt" for s in trio]) if c not in rows.columns]:
        raise ValueError(f"{path} lacks required columns: {', '.join(missing)}")
    contig, start, end = region
    rows = rows.withColumn("pos", F.col("pos").cast("long")).filter((F.col("contig") == contig) & F.col("pos").between(start, end))
    x, d, o = (F.col(f"`{s}_gt`") for s in trio)
    pattern = F.when((d == o) & (d == x), "all_same").when((d == o) & (d != x), "target_private").when((d == x) & (d != o), "background_like").otherwise("other")
    return rows.withColumns({"pattern_class": pattern, "display_type": vcf.display_type(F.col("ref"), F.split("alt", ","), sv_length)}).orderBy("pos", "ord")


def models(spark: SparkSession, path: str, region: tuple[str, int, int], promoter_bp: int) -> DataFrame:
    """(gene_id, gene_name, part, start, end): genes that meet the region with their exons, introns, CDS and promoters, cut to it."""
    contig, start, end = region
    rows = gff.read_gff(spark, path, decode=True).filter(F.col("contig") == contig).withColumn("start", F.col("start") + 1)
    attr = lambda k: F.try_element_at("attrs", F.lit(k))
    genes = rows.filter((F.col("type") == "gene") & (F.col("start") <= end) & (F.col("end") >= start)).select(attr("ID").alias("gid"), F.col("gene_id").alias("gene_name"), "start", "end", "strand")
    scripts = rows.filter(F.col("type").isin("mRNA", "transcript")).select(attr("ID").alias("transcript_id"), F.explode(F.split(attr("Parent"), ",")).alias("gid"), "start", "end", F.coalesce(attr("longest") == "1", F.lit(False)).alias("longest"))
    chosen = focus.chosen_transcript(scripts.join(genes.select("gid"), "gid", "left_semi").withColumnRenamed("gid", "gene_id")).select("transcript_id", "gene_id")
    parts = rows.filter(F.col("type").isin("exon", "CDS")).select(F.explode(F.split(attr("Parent"), ",")).alias("transcript_id"), "type", "start", "end", "strand").join(chosen, "transcript_id")
    features = genes.select(F.col("gid").alias("gene_id"), F.lit("gene").alias("type"), "start", "end", "strand").unionByName(parts.select("gene_id", "type", "start", "end", "strand"))
    made = focus.gene_models(features, promoter_bp).join(genes.select(F.col("gid").alias("gene_id"), "gene_name"), "gene_id")
    return focus.clipped(made, start, end).withColumn("part", F.when(F.col("part") == "cds", "CDS").otherwise(F.col("part")))


def feature_table(spark: SparkSession, sites: DataFrame, parts: DataFrame | None, tracks: list[tuple[str, str]], functional: DataFrame | None, region: tuple[str, int, int]) -> DataFrame:
    """One row per gene, promoter, exon, intron, CDS and track feature, with the counts of target-private variants and functional texts."""
    contig, start, end = region
    rows = [parts.select(F.col("part").alias("feature_type"), "gene_id", F.col("gene_name").alias("gene"), "start", "end", F.lit("").alias("extra"))] if parts is not None else []
    for label, path in tracks:
        own = focus.clipped(gff.read_gff(spark, path, decode=True, strict=True).filter(F.col("contig") == contig).withColumn("start", F.col("start") + 1), start, end)
        kind = F.coalesce(F.try_element_at("attrs", F.lit("class")), F.try_element_at("attrs", F.lit("Class")), F.col("type"))
        rows.append(own.select(F.lit(label).alias("feature_type"), "gene_id", F.lit("").alias("gene"), "start", "end", kind.alias("extra")))
    if not rows:
        return spark.createDataFrame([], "feature_type string, gene_id string, gene string, start long, end long, extra string, snp_n long, indel_n long, sv_n long, functional string")
    features = reduce(DataFrame.unionByName, rows)
    features = stored(features.withColumns({"ord": F.monotonically_increasing_id(), "contig": F.lit(contig)}), "features")
    private = sites.filter("pattern_class = 'target_private'").select("contig", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), "display_type")
    counted = feature_counts(features.withColumn("start", F.col("start") - 1), private).withColumn("start", F.col("start") + 1)
    if functional is not None:
        # features of further tracks belong to no gene
        named = counted.withColumnRenamed("gene_id", "feature_id").withColumns({"gene_name": F.col("gene"), "gene_id": F.when(F.col("gene") != "", F.col("feature_id"))})
        counted = focus.functional(named, functional).drop("gene_name", "gene_id").withColumnRenamed("feature_id", "gene_id")
    return counted.withColumn("functional", F.col("functional") if functional is not None else F.lit(None).cast("string"))


def read_functional(spark: SparkSession, path: str) -> DataFrame:
    """A functional table with ``text`` from the first of its describing columns that is filled."""
    rows = tables.read_tsv(spark, path)
    known = [c for c in ("representative_predicted_function", "product", "description", "functional_category_keywords") if c in rows.columns]
    return rows.withColumn("text", F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in known]) if known else F.lit(None).cast("string"))


def _groups(candidates: DataFrame, keywords: dict[str, tuple[str, ...]]) -> list[dict]:
    """Built-in groups (all, gene models, promoters, other tracks) and keyword groups, each with its rows in rank order."""
    rows = [r.asDict() for r in candidates.orderBy("rank").collect()]  # at most the candidate limit
    model = {"gene", "exon", "intron", "CDS"}
    out = [("all", "All features with variants", rows), ("gene_models", "Genes, exons, introns, CDS", [r for r in rows if r["feature_type"] in model]), ("promoters", "Promoters", [r for r in rows if r["feature_type"] == "promoter"]), ("extra_tracks", "Further tracks", [r for r in rows if r["feature_type"] not in model | {"promoter"}])]
    used = {k for k, *_ in out}
    found = focus.candidate_groups(candidates, keywords, ("feature_type", "gene_id", "gene", "functional", "extra")).collect() if keywords else []
    for name in keywords:
        key = base = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "keyword_group"
        n = 2
        while key in used:
            key, n = f"{base}_{n}", n + 1
        used.add(key)
        out.append((key, name, sorted((r.asDict() for r in found if r["group"] == name), key=lambda r: r["rank"])))
    return [{"key": k, "title": t, "rows": r} for k, t, r in out]


def pages(spark: SparkSession, regions: list[str], trio: tuple[str, str, str], outdir: str, vcf_path: str | None = None, sites_path: str | None = None, gff_path: str | None = None, tracks: list[tuple[str, str]] = (), functional_path: str | None = None, keywords: dict | None = None, names: dict | None = None, promoter_bp: int = 2000, sv_length: int = 50, limit: int = 500, pass_only: bool = True, all_called: bool = True, variant_type: str = "all", biallelic_only: bool = False) -> list[dict]:
    """One page with its JSON per region (and an index page for several); sites come from a table or from a VCF."""
    from cladespark.operators.summaries import candidate_features

    out = []
    parsed = [focus.parse_focus(r) for r in regions]
    for text, region in zip(regions, parsed):
        contig, start, end = region
        slug = re.sub(r"[^A-Za-z0-9.]+", "_", f"{contig}_{start}_{end}")
        counters: dict = {}
        if sites_path:
            sites = read_sites(spark, sites_path, region, trio, sv_length)
        else:
            samples, _ = vcf.header(spark, vcf_path)
            marked, counted = extract_sites(vcf.read_vcf(spark, vcf_path), samples, trio, region, pass_only, all_called, variant_type, biallelic_only)
            counters = counted.first().asDict()
            genes = gff.read_gff(spark, gff_path, types=("gene",), decode=True) if gff_path else None
            sites = stored(site_table(marked.filter("reason is null"), samples, trio, genes, sv_length), "sites")
            write_tsv(sites.orderBy("pos", "ord").drop("ord"), f"{outdir}/{slug}.sites.tsv")
        parts = models(spark, gff_path, region, promoter_bp) if gff_path else None
        features = feature_table(spark, sites, parts, list(tracks), read_functional(spark, functional_path) if functional_path else None, region)
        bonus = F.when(F.col("feature_type").isin("promoter", "exon", "CDS"), 2).otherwise(0)
        best = candidate_features(features.withColumns({"bonus": F.when(F.col("snp_n") + F.col("indel_n") + F.col("sv_n") > 0, bonus).otherwise(0), "part": F.col("feature_type")}), limit)
        kinds = {r["pattern_class"]: r["count"] for r in sites.groupBy("pattern_class").count().collect()}
        payload = {
            "region": {"contig": contig, "start": start, "end": end}, "samples": [{"name": s, "label": (names or {}).get(s, s)} for s in trio], "counters": counters, "patterns": kinds,
            "sites": [r.asDict() for r in sites.orderBy("pos").drop("ord").limit(20_000).collect()], "bins": [r.asDict() for r in region_bins(sites, start, end).orderBy("bin").collect()],
            "features": [r.asDict() for r in features.orderBy("start", "feature_type", "gene_id").limit(20_000).collect()], "candidate_groups": _groups(best, keywords or {}),
        }
        dashboards.write_page(payload, f"{outdir}/{slug}.html", text)
        out.append(payload)
    if len(out) > 1:
        links = [{"region": t, "page": re.sub(r"[^A-Za-z0-9.]+", "_", f"{c}_{s}_{e}") + ".html"} for t, (c, s, e) in zip(regions, parsed)]
        dashboards.write_page({"pages": links}, os.path.join(outdir, "index.html"), "focus")
    return out
