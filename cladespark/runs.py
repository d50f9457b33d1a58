"""Whole commands: read, compute, write the tables of one run."""

from __future__ import annotations

import os
from datetime import UTC, datetime
from functools import reduce
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark import figures
from cladespark import scan as scans
from cladespark.cohort import Cohort, inferred_groups
from cladespark.config import ReadSettings, Settings
from cladespark.dashboards import read_json
from cladespark.functions.rounding import fixed, half_even
from cladespark.operators import annotate as ann
from cladespark.operators import compare as cmp
from cladespark.operators import kernel, landscape, pangenome, plot_data, summaries
from cladespark.operators.ordering import stored
from cladespark.operators.summaries import contig_summary
from cladespark.operators.windows import record_index
from cladespark.sinks import bed_line, gff3_line, write_json, write_lines, write_tsv
from cladespark.sources import gfa, gff, sam, tables, vcf
from cladespark.sources.text import parse_region


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def _qc_table(spark: SparkSession, counters: dict[str, int]) -> DataFrame:
    known = dict(scans.QC_METRICS)
    return spark.createDataFrame([(k, str(v), known.get(k, f"alleles classified as {k.removeprefix('strictness_')}")) for k, v in counters.items()], "metric string, value string, description string")


def _read_support(spark: SparkSession, loci: DataFrame, files: list[tuple[str, str]], cohort: Cohort, reads: ReadSettings) -> DataFrame:
    """Evidence of every (locus, sample of a read file): counts, depth, allele fraction, class and value; ignored samples are left out."""
    own = [(path, sample) for path, sample in files if sample not in cohort.ignored]
    blocks = reduce(DataFrame.unionByName, [sam.aligned_blocks(sam.read_sam(spark, path, sample), reads.min_mapq) for path, sample in own])
    counts = sam.allele_counts(loci, blocks, list(dict.fromkeys(s for _, s in own)), reads.min_baseq)
    return sam.read_evidence(counts, cohort.targets, reads.min_depth, reads.allele_fraction_min, reads.min_alt_count)


def _fraction_text(fraction) -> Column:
    """A fraction of four decimals as the shortest text with at least one."""
    text = F.regexp_replace(F.format_string("%.4f", fraction), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def scan_vcf(spark: SparkSession, path: str, cohort: Cohort, outdir: str, region: str | None = None, merge_distance: int = 0, same_type: bool = False, read_files: list[tuple[str, str]] | None = None, settings: Settings | None = None, **options) -> DataFrame:
    """hits, regions, evidence, sample_support, qc and run.json; returns the ranked hits.

    ``read_files`` are (SAM file, sample) pairs: reads at the hits give the support
    score, the second kind of evidence, and depth and allele fraction by sample.
    """
    began, settings = _now(), settings or Settings()
    samples, contigs = vcf.header(spark, path)
    records = vcf.read_vcf(spark, path, region)
    alleles = stored(scans.vcf_alleles(records, samples, cohort, **options), "alleles")  # read by hits and by QC
    place = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in contigs]), F.col("contig")), F.lit(0)) if contigs else F.lit(0)
    hits = scans.with_ids(alleles.filter("pattern_pass").withColumn("_c", place), "PPX", F.col("_c").asc(), F.col("rec_ord").asc(), F.col("alt_i").asc())
    evidence = None
    if read_files:
        hits = stored(hits, "numbered")
        evidence = stored(_read_support(spark, hits.select("ord", "contig", "start", "end", "ref", "alt", "variant_type"), read_files, cohort, settings.bam), "read_evidence")
        hits = kernel.score(hits.join(sam.locus_support(evidence), "ord", "left"), options.get("weights", settings.scoring.weights()), support="support")
    hits = stored(kernel.ranked(hits), "hits")
    regions = stored(scans.regions_of(hits, merge_distance, same_type), "regions")
    support = scans.sample_support(hits, samples, cohort)
    write_tsv(hits.orderBy("rank"), f"{outdir}/hits.tsv", tables.HITS)
    shown = regions.withColumns({c: half_even(F.col(c), 4) for c in ("target_consistency", "offtarget_exclusion")} | {"final_score": half_even(F.col("final_score"), 6)})
    write_tsv(shown.orderBy("region_id"), f"{outdir}/regions.tsv", tables.REGIONS)
    na = F.lit("NA")
    rows = hits.orderBy("ord").select("ord", "locus_id", F.lit("vcf").alias("source_type"), F.lit("").alias("sample_id"), F.lit("support").alias("evidence_class"), F.lit("allele_pattern").alias("metric_name"), F.col("final_score").cast("string").alias("metric_value"), F.col("pattern_reason").alias("details"), F.lit(0).alias("part"), F.lit(0).alias("k"))
    if evidence is None:
        support = support.withColumns({"depth": na, "allele_fraction": na})
    else:
        snp = F.col("variant_type") == "snp"
        named = evidence.join(hits.select("ord", "locus_id", "contig", "start"), "ord")
        order = F.create_map(*[F.lit(x) for k, (_, s) in enumerate(read_files) for x in (s, k)])[F.col("sample")]
        rows = rows.unionByName(named.select("ord", "locus_id", F.lit("bam").alias("source_type"), F.col("sample").alias("sample_id"), "evidence_class", F.when(snp, "allele_fraction").otherwise("depth").alias("metric_name"), F.when(snp, _fraction_text(F.col("allele_fraction"))).otherwise(F.col("depth").cast("double").cast("string")).alias("metric_value"), F.format_string("BAM pileup at %s:%d", "contig", "start").alias("details"), F.lit(1).alias("part"), order.alias("k")))
        own = named.select("locus_id", F.col("sample").alias("sample_id"), F.col("depth").cast("string").alias("depth"), F.when(snp, _fraction_text(F.col("allele_fraction"))).otherwise("NA").alias("allele_fraction"))
        support = support.join(own, ["locus_id", "sample_id"], "left").na.fill("NA", ["depth", "allele_fraction"])
    support = support.withColumn("allele_supported", F.col("allele_supported").cast("string"))
    write_tsv(support.orderBy("rank", "k"), f"{outdir}/sample_support.tsv", tables.SAMPLE_SUPPORT)
    write_tsv(rows.orderBy("part", "k", "ord"), f"{outdir}/evidence.tsv", tables.EVIDENCE)
    counters = scans.qc(records, alleles, samples, cohort, regions, **options)
    write_tsv(_qc_table(spark, counters), f"{outdir}/qc.tsv", tables.QC)
    _write_run(outdir, "scan", path, cohort, began, counters, settings)
    return hits


def _write_run(outdir: str, command: str, path: str, cohort: Cohort, began: str, counters: dict, settings: Settings) -> None:
    from cladespark import __version__

    write_json(f"{outdir}/run.json", {"command": command, "project_name": settings.project_name, "version": __version__, "input": path, "targets": cohort.targets, "off_targets": cohort.off_targets, "ignored_samples": cohort.ignored, "start_time": began, "end_time": _now(), "counters": counters, "config": settings.as_dict()})


def scan_gfa(spark: SparkSession, path: str, cohort: Cohort, outdir: str, index: str | None = None, region: str | None = None, merge_distance: int = 0, min_length: int = 1, settings: Settings | None = None, **options) -> DataFrame:
    """hits, graph_segments, regions, qc and run.json of a graph; an index beside the graph is used, one that doesn't fit is an error."""
    began, settings = _now(), settings or Settings()
    tables_ = gfa.index_for(spark, path, index)
    cohort.check_samples([r["sample"] for r in tables_["segment_sample"].select("sample").distinct().collect()])
    scanned = stored(scans.scan_gfa(tables_, cohort, min_length=min_length, region=parse_region(region), **options), "segments")
    hits = stored(scans.gfa_hits(scanned), "hits")
    write_tsv(hits.orderBy("rank"), f"{outdir}/hits.tsv", tables.HITS)
    length = F.col("end") - F.col("start")
    segments = hits.select("locus_id", "contig", "start", "end", F.col("name").alias("segment_name"), length.alias("segment_length"), "segment_length_class", F.col("target_support_n").alias("target_traverse_n"), "target_total_n", (F.col("target_total_n") - F.col("target_missing_n")).alias("target_coordinate_covered_n"), "target_missing_n", F.col("offtarget_support_n").alias("offtarget_same_segment_traverse_n"), (F.col("offtarget_total_n") - F.col("offtarget_missing_n") - F.col("offtarget_support_n")).alias("offtarget_same_segment_absent_n"), (F.col("offtarget_total_n") - F.col("offtarget_missing_n")).alias("offtarget_coordinate_covered_n"), "offtarget_missing_n", "offtarget_total_n", "strictness_class", scans.graph_interpretation().alias("interpretation"), "rank")
    write_tsv(segments.orderBy("rank").drop("rank"), f"{outdir}/graph_segments.tsv")
    regions = scans.regions_of(hits, merge_distance, prefix="GFAR")
    write_tsv(regions.orderBy("region_id"), f"{outdir}/regions.tsv", tables.REGIONS)
    counts = {r[0]: r[1] for r in scanned.groupBy("strictness_class").count().collect()}
    counters = {"segments_evaluated": sum(counts.values()), "segments_contradicted": counts.get("contradicted", 0), "segments_passed": hits.count()}
    write_tsv(_qc_table(spark, counters), f"{outdir}/qc.tsv", tables.QC)
    _write_run(outdir, "scan", path, cohort, began, counters, settings)
    return hits


def compare(spark: SparkSession, hits_a: str, hits_b: str, outdir: str, rules: cmp.CompareRules = cmp.CompareRules(), source_a: str | None = None, source_b: str | None = None) -> DataFrame:
    """compare.tsv, compare_summary.tsv and compare.json."""
    os.makedirs(outdir, exist_ok=True)
    a, b = tables.read_hits(spark, hits_a), tables.read_hits(spark, hits_b)
    label_a, label_b = tables.source_label(a, source_a), tables.source_label(b, source_b)
    rows = stored(cmp.in_output_order(cmp.compare(a, b, rules)), "compare")
    paired = F.col("method").isNotNull()
    shown = rows.withColumns({"source_a": F.when(F.col("locus_id_a").isNotNull(), label_a), "source_b": F.when(F.col("locus_id_b").isNotNull(), label_b), "coordinate_overlap": F.when(paired, fixed(F.col("overlap"), 4)).otherwise("0.0000"), "support_summary": F.concat_ws(" ", "match_class", "method"), "contradiction_summary": F.when(F.col("match_class") == "contradicted", F.concat_ws("/", "strictness_a", "strictness_b"))})
    names = "compare_id locus_id_a locus_id_b source_a source_b contig start_a end_a start_b end_b match_class coordinate_overlap state_compatibility strictness_a strictness_b support_summary contradiction_summary comparison_score".split()
    write_tsv(shown.orderBy("n"), f"{outdir}/compare.tsv", names)
    summary = cmp.summary(rows)
    write_tsv(summary.orderBy("match_class").select("match_class", "n_loci", fixed(F.col("pct_total"), 1).alias("pct_total"), fixed(F.col("mean_overlap"), 4).alias("mean_overlap"), fixed(F.col("mean_score"), 4).alias("mean_score")), f"{outdir}/compare_summary.tsv")
    write_json(f"{outdir}/compare.json", {"source_a": label_a, "source_b": label_b, "rules": rules.__dict__, "diagnostics": cmp.diagnostics(a, b, rows, rules)})
    return rows


def landscape_vcf(spark: SparkSession, path: str, targets, outdir: str, off_targets=None, ignored=(), window: int = 200, step: int = 50, min_called: int = 10, min_freq_values: int = 10, background: float = 0.65, introgression: dict | None = None, pca: bool = False, window_bp: int | None = None, step_bp: int | None = None, rare_max_count: int = 1, rare_max_freq: float = 0.05, **filters) -> dict[str, DataFrame]:
    """Filter summary, sample windows, windows, similarity and blocks of a VCF, in windows of records or, with ``window_bp``, of base pairs."""
    own = introgression or {}
    kinds = filters.get("variant_types")
    landscape.checked_parameters(
        window_records=window, step_records=step, window_bp=window_bp, step_bp=step_bp, min_called_for_freq=min_called, min_freq_values=min_freq_values, min_background_similarity=background, rare_max_count=rare_max_count, rare_max_freq=rare_max_freq,
        min_introgression_similarity=own.get("min_similarity"), min_introgression_delta=own.get("min_delta"), max_introgression_missing_rate=own.get("max_missing"), min_introgression_windows=own.get("min_windows"),
        max_site_missing_rate=filters.get("max_missing_rate"), min_alt_carriers=filters.get("min_carriers"), min_alt_carrier_freq=filters.get("min_freq"), max_alt_carrier_freq=filters.get("max_freq"), variant_type=kinds[0] if kinds else None,
    )
    samples, contigs = vcf.header(spark, path)
    groups = inferred_groups(samples, targets, off_targets, ignored)
    active = [s for s in samples if s not in set(ignored)]
    pick = F.array(*[F.get("gts", F.lit(samples.index(s))) for s in active])
    records = landscape.filter_reason(landscape.checked_runs(vcf.read_vcf(spark, path)).withColumn("gts", pick), **filters)
    write_tsv(landscape.filter_summary(records).orderBy("n").drop("n"), f"{outdir}/filter_summary.tsv")
    kept = record_index(records.filter("skip_reason is null"), ["contig"], "rec_ord")
    role_name = lambda s: "target" if s in groups["target"] else "off_target" if s in groups["off_target"] else "other"
    entries = [F.struct(F.lit(s).alias("sample"), F.lit(role_name(s)).alias("role"), F.get("gts", F.lit(k)).alias("gt")) for k, s in enumerate(active)]
    arrays = stored(kept.select("contig", F.col("i").cast("long").alias("i"), "n", "start", F.greatest("end", F.col("start") + 1).alias("end"), F.array(*entries).alias("x")), "records")
    bridge = stored(landscape.bp_bridge(arrays, window_bp, step_bp or window_bp), "bridge") if window_bp else None
    marks = stored(landscape.variant_marks(arrays, rare_max_count, rare_max_freq, min_called_for_freq=min_called), "marks")
    rows = landscape.sample_windows(marks, window, step, min_freq_values, bridge)
    pairs = stored(landscape.pair_similarity(arrays, window, step, bridge), "pairs")
    role = F.element_at(F.create_map(*[F.lit(x) for s in active for x in (s, role_name(s))]), F.col("nearest"))
    place = F.array_position(F.array(*[F.lit(s) for s in active]), F.col("sample"))
    near = landscape.nearest_background(pairs).withColumn("nearest_role", role)
    closest = landscape.nearest_background(pairs, groups["target"]).select("contig", "w", "sample", F.col("nearest_similarity").alias("target_similarity"))
    rows = stored(rows.join(near, ["contig", "w", "sample"], "left").join(closest, ["contig", "w", "sample"], "left"), "sample_windows")
    order = {c: k for k, c in enumerate(contigs)} or None
    windows = landscape.with_window_ids(landscape.window_rows(rows, near.withColumn("sample_ord", place)), order)
    ids = windows.select("contig", "w", "window_id")
    out = {
        "sample_windows": rows.join(ids, ["contig", "w"]), "windows": windows, "similarity": pairs.join(ids, ["contig", "w"]), "background_blocks": landscape.with_block_ids(landscape.background_blocks(rows, background), "LB"),
        "candidate_introgression_blocks": landscape.with_block_ids(landscape.introgression_blocks(rows, **own), "IB"), "similarity_summary": landscape.similarity_summary(pairs), "contig_summary": contig_summary(windows),
    }
    if pca:
        out["local_pca"] = landscape.local_pca(pairs, tuple(active))
    for name, df in out.items():
        doubles = {c: fixed(F.col(c), 6) for c, t in df.dtypes if t == "double"}
        keys = [c for c in ("sample", "contig", "w", "start", "sample_a", "sample_b") if c in df.columns]
        write_tsv(df.orderBy(*keys).withColumns(doubles), f"{outdir}/{name}.tsv", [c for c in df.columns if c != "island"])
    mode = {"window_bp": window_bp, "step_bp": step_bp or window_bp} if window_bp else {"window_records": window, "step_records": step}
    write_json(f"{outdir}/landscape.json", {"input": path, **mode, "groups": groups, "filters": filters})
    return out


def pangenome_tables(features: DataFrame, presence: DataFrame, groups: dict, outdir: str, trials: int = 100, seed: int = 42) -> dict[str, DataFrame]:
    os.makedirs(outdir, exist_ok=True)
    out = {"feature_summary": pangenome.feature_summary(features, presence, groups), "coverage_histogram": pangenome.coverage_histogram(features, presence, groups), "composition": pangenome.composition(features, presence, groups), "growth_curves": pangenome.growth_curves(features, presence, groups, trials, seed)}
    for name, df in out.items():
        write_tsv(df.orderBy(*[c for c in ("grp", "trial", "n", "present_n", "category", "feature_id") if c in df.columns]), f"{outdir}/{name}.tsv")
    write_json(f"{outdir}/pangenome.json", {"groups": groups, "permutations": trials, "seed": seed})
    return out


def vcf_matrix(records: DataFrame, samples: list[str]) -> tuple[DataFrame, DataFrame]:
    """features and presence of every ALT allele, without FILTER or QUAL; ids are the shortened allele keys, the last of equal ones gives presence."""
    rows = records.filter("alts is not null").select("contig", "pos", "start", "end", "ref", "gts", "rec_ord", F.posexplode("alts").alias("k", "alt"))
    rows = rows.withColumn("feature_id", vcf.allele_key(F.col("contig"), F.col("pos"), F.col("ref"), F.col("alt")))
    names = F.array(*[F.lit(s) for s in samples])
    carriers = F.filter(F.transform("gts", lambda g, i: F.when(~landscape.missing(g) & F.array_contains(g, F.col("k") + 1), F.get(names, i))), lambda s: s.isNotNull())
    rows = rows.withColumn("carriers", carriers)
    features = rows.select("feature_id", "contig", "start", F.greatest(F.length("ref"), F.length("alt")).cast("long").alias("length_bp"))
    last = rows.groupBy("feature_id").agg(F.max_by("carriers", F.struct("rec_ord", "k")).alias("carriers"))
    return features, last.select("feature_id", F.explode("carriers").alias("sample"))


def gfa_matrix(graph: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    features = graph["segments"].select(F.col("name").alias("feature_id"), "contig", "start", F.col("length").alias("length_bp"))
    return features, gfa.segment_samples(graph).select(F.col("segment").alias("feature_id"), "sample").join(features.select("feature_id"), "feature_id", "left_semi")


def annotate_hits(spark: SparkSession, hits: str, gff_path: str, outdir: str, aliases: str | None = None, inverted: bool = True) -> DataFrame:
    os.makedirs(outdir, exist_ok=True)
    genes, parts = gff.genes_and_parts(gff.read_gff(spark, gff_path))
    names = gff.read_aliases(spark, aliases, inverted) if aliases else None
    out = stored(ann.annotate(tables.read_hits(spark, hits), genes, parts, names), "annotated")
    write_tsv(out.orderBy("ord"), f"{outdir}/annotated_hits.tsv", [*tables.HITS, "annotation_class", "gene_id", "gene_strand", "gene_start", "gene_end"])
    summary = ann.annotation_summary(out)
    write_tsv(summary.withColumn("pct_total", half_even(F.col("pct_total"), 2)).orderBy("annotation_class"), f"{outdir}/annotation_summary.tsv")
    return out


def export(spark: SparkSession, path: str, out: str, kind: str = "hits", form: str = "bed", track: str | None = None) -> None:
    """BED or GFF3 of hits or regions."""
    rows = tables.read_tsv(spark, path).withColumns({c: F.col(c).cast("long") for c in ("start", "end")})
    key = "locus_id" if kind == "hits" else "region_id"
    if form == "bed":
        more = ("strictness_class", "allele_key") if kind == "hits" else ("dominant_strictness_class", "variant_types")
        line, head = bed_line(key, "final_score", more), [f'track name="{track}"'] if track else []
    else:
        names = [key, "variant_type", "allele_key", "strictness_class"] if kind == "hits" else [key, "n_loci", "variant_types", "dominant_strictness_class"]
        line, head = gff3_line("final_score", names, "sequence_variant" if kind == "hits" else "region"), ["##gff-version 3"]
    write_lines(rows.orderBy("ord").select(line.alias("line")), out, head)


def export_all(spark: SparkSession, outdir: str, hits: str | None, regions: str | None, kind: str = "both", form: str = "bed", track: str | None = None) -> list[str]:
    """Exports of hits, regions or both, and export.json; a table asked for and not given is an error."""
    out = []
    for name, path in (("hits", hits), ("regions", regions)):
        if kind not in (name, "both") or (kind == "both" and not path):
            continue
        if not path or not os.path.exists(path):
            raise FileNotFoundError(f"no {name} table: {path}")
        out.append(f"{outdir}/{name}.{form}")
        export(spark, path, out[-1], name, form, track)
    if not out:
        raise FileNotFoundError("neither hits nor regions are given")
    write_json(f"{outdir}/export.json", {"format": form, "outputs": out})
    return out


def _markdown(title: str, parts: list[tuple[str, list[str], list[tuple]]], notes: list[str]) -> str:
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    page = [f"# {title}", "", *notes, ""]
    for name, columns, rows in parts:
        page += [f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows], ""]
    return "\n".join(page)


def _html(title: str, parts: list[tuple[str, list[str], list[tuple]]], notes: list[str]) -> str:
    text = lambda v: escape(str("" if v is None else v))
    page = ["<!doctype html><meta charset=utf-8>", f"<title>{text(title)}</title>", "<style>body{font-family:sans-serif;margin:2em}td,th{border:1px solid #ccc;padding:.2em .6em}table{border-collapse:collapse}</style>", f"<h1>{text(title)}</h1>", *[f"<p>{text(n)}</p>" for n in notes]]
    for name, columns, rows in parts:
        page += [f"<h2>{text(name)}</h2>", "<table><tr>" + "".join(f"<th>{text(c)}</th>" for c in columns) + "</tr>", *["<tr>" + "".join(f"<td>{text(v)}</td>" for v in r) + "</tr>" for r in rows], "</table>"]
    return "\n".join(page)


def report(spark: SparkSession, hits: str, outdir: str, evidence: str | None = None, top_n: int = 20, regions: str | None = None, qc: str | None = None, compared: str | None = None, run: str | None = None, html: bool = True, sections: tuple[str, ...] | None = None, title: str = "Report") -> dict[str, DataFrame]:
    """ranked_hits, strictness, support, contradiction and run summaries, a Markdown page and the same as HTML; inputs that don't exist are left out."""
    table = lambda path: tables.read_tsv(spark, path) if path and os.path.exists(path) else None
    rows = tables.read_hits(spark, hits)
    out = {"ranked_hits": kernel.top(rows, top_n).select("rank", *tables.HITS).orderBy("rank"), "strictness_summary": summaries.strictness_summary(rows).orderBy("place", "strictness_class").drop("place")}
    if (own := table(evidence)) is not None:
        share = half_even(100 * F.col("share"), 1)
        out["support_summary"] = summaries.support_summary(own).withColumn("pct_of_source", share).drop("share").orderBy("source_type", "evidence_class")
    metrics = lambda got: spark.createDataFrame(got, "metric string, value string, description string").coalesce(1)
    if got := summaries.contradiction_summary(table(qc), table(compared)):
        out["contradiction_summary"] = metrics(got)
    out["summary"] = metrics(summaries.run_summary(rows, table(regions), table(qc), read_json(run) if run else None))
    if sections is not None:
        out = {k: v for k, v in out.items() if k in sections}
    for name, df in out.items():
        write_tsv(df, f"{outdir}/{name}.tsv")
    parts = [(name, df.columns, [tuple(r) for r in df.limit(100).collect()]) for name, df in out.items()]
    notes = [f"{rows.count()} hits."]
    with open(f"{outdir}/report.md", "w", encoding="utf-8") as f:
        f.write(_markdown(title, parts, notes))
    if html:
        with open(f"{outdir}/report.html", "w", encoding="utf-8") as f:
            f.write(_html(title, parts, notes))
    return out


#: Kinds of plot tables (fixed names).
PLOTS = ("locus_panel", "strictness_bar", "score_distribution", "support_bar", "compare_summary")


def plot_tables(spark: SparkSession, hits: str, outdir: str, kind: str = "all", evidence: str | None = None, compared: str | None = None, top_n: int = 30) -> dict[str, DataFrame]:
    """The tables behind the scan's figures, of one kind or all that the inputs allow; a kind whose input isn't given is an error."""
    if kind != "all" and kind not in PLOTS:
        raise ValueError(f"plot type must be all or one of {', '.join(PLOTS)}")
    rows, wanted = tables.read_hits(spark, hits), lambda k: kind in ("all", k)
    out: dict[str, DataFrame] = {}
    if wanted("locus_panel"):
        out["locus_panel"] = kernel.top(rows, top_n).select("rank", "locus_id", "contig", "start", "strictness_class", "final_score").orderBy("rank")
    if wanted("strictness_bar"):
        out["strictness_bar"] = summaries.strictness_summary(rows).orderBy("place", "strictness_class").drop("place")
    if wanted("score_distribution"):
        out["score_distribution"] = summaries.score_histogram(rows).orderBy("strictness_class", "bin")
    for name, path, columns, option in (("support_bar", evidence, ("source_type", "evidence_class"), "--evidence"), ("compare_summary", compared, ("match_class",), "--compare")):
        if path and os.path.exists(path):
            if wanted(name):
                out[name] = plot_data.class_counts(tables.read_tsv(spark, path), *columns).orderBy(*columns)
        elif kind == name:
            raise ValueError(f"{option} is needed for {name}")
    for name, df in out.items():
        write_tsv(df, f"{outdir}/{name}.tsv")
        _write_svg(f"{outdir}/{name}.svg", _scan_figure(name, [r.asDict() for r in df.collect()]))  # as many rows as bars
    update_outputs(f"{outdir}/plots.json", [f"{outdir}/{name}.{form}" for name in out for form in ("tsv", "svg")], {"plot_type": kind, "top_n": top_n})
    return out


def _write_svg(path: str, text: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _stacked(rows: list[dict], label: str, group: str, value: str) -> tuple[list, dict]:
    labels, groups = list(dict.fromkeys(r[label] for r in rows)), list(dict.fromkeys(r[group] for r in rows))
    have = {(r[label], r[group]): r[value] for r in rows}
    return labels, {str(g): [have.get((x, g), 0) for x in labels] for g in groups}


def _scan_figure(name: str, rows: list[dict]) -> str:
    if name == "locus_panel":
        return figures.lollipops("Best hits", [r["locus_id"] for r in rows], [r["final_score"] for r in rows], [r["strictness_class"] for r in rows])
    if name == "strictness_bar":
        return figures.bars("Hits by strictness", [r["strictness_class"] for r in rows], {"hits": [r["n_loci"] for r in rows]})
    if name == "score_distribution":
        labels, series = _stacked(sorted(rows, key=lambda r: r["bin"]), "bin", "strictness_class", "n")
        return figures.bars("Scores", labels, series)
    if name == "support_bar":
        return figures.bars("Evidence", *_stacked(rows, "source_type", "evidence_class", "n"))
    return figures.bars("Matches", [r["match_class"] for r in rows], {"matches": [r["n"] for r in rows]})


def landscape_plot_tables(spark: SparkSession, folder: str, outdir: str) -> dict[str, DataFrame]:
    """The tables behind a landscape's figures: heatmap, density, similarity in leaf order, and the index by contig."""
    windows, rows, pairs = (tables.read_tsv(spark, f"{folder}/{n}.tsv") for n in ("windows", "sample_windows", "similarity"))
    number = lambda df, *names: df.withColumns({c: F.col(c).try_cast("double") for c in names} | {c: F.col(c).cast("long") for c in ("w", "start", "end") if c in df.columns})
    windows, rows, pairs = number(windows, "density_variants_per_kb", "n_variants"), number(rows, "nonref_rate"), number(pairs, "similarity")
    names = [r["sample"] for r in rows.select("sample").distinct().orderBy("sample").collect()]
    order, matrix = plot_data.leaf_order(plot_data.mean_similarity(pairs), names)
    cells = [(a, b, float(matrix[i, j]), i, j) for i, a in enumerate(order) for j, b in enumerate(order)]
    out = {"heatmap": plot_data.heatmap(rows, "nonref_rate", names).orderBy("contig", "w"), "density": plot_data.density_profile(windows), "cluster_map": spark.createDataFrame(cells, "sample_a string, sample_b string, similarity double, row int, column int").orderBy("row", "column"), "index": plot_data.plot_index(windows).orderBy("contig")}
    for name, df in out.items():
        write_tsv(df, f"{outdir}/{name}.tsv")
    _write_svg(f"{outdir}/cluster_map.svg", figures.cells("Mean similarity", order, order, matrix.tolist()))
    heat = out["heatmap"].limit(2000).collect()  # a figure has no room for more windows
    _write_svg(f"{outdir}/heatmap.svg", figures.cells("Non-reference rate", names, [f"{r['contig']}:{r['start']}" for r in heat], [[r[s] for r in heat] for s in names]))
    dense: dict[str, list] = {}
    for r in out["density"].limit(20_000).collect():
        dense.setdefault(r["contig"], []).append((r["start"], r["density_variants_per_kb"] or 0.0))
    _write_svg(f"{outdir}/density.svg", figures.lines("Variants per kb", dense))
    update_outputs(f"{folder}/landscape.json", [f"{outdir}/{name}.tsv" for name in out] + [f"{outdir}/{name}.svg" for name in ("cluster_map", "heatmap", "density")], {})
    return out


def pangenome_plot_tables(spark: SparkSession, folder: str, outdir: str) -> dict[str, DataFrame]:
    """Growth with its quantile band, coverage and composition of a pangenome folder, as tables and figures."""
    number = lambda name, *columns: tables.read_tsv(spark, f"{folder}/{name}.tsv").withColumns({c: F.col(c).cast("double") for c in columns})
    out = {"growth": pangenome.growth_summary(number("growth_curves", "n", "features", "bp")).orderBy("grp", "n"), "coverage": number("coverage_histogram", "present_n", "features").select("grp", "present_n", "features").orderBy("grp", "present_n"), "composition": number("composition", "features").select("grp", "category", "features").orderBy("grp", "category")}
    rows = {name: [r.asDict() for r in df.collect()] for name, df in out.items()}  # as many as groups, places and categories
    for name, df in out.items():
        write_tsv(df, f"{outdir}/{name}.tsv")
    groups = list(dict.fromkeys(r["grp"] for r in rows["growth"]))
    own = lambda g: [r for r in rows["growth"] if r["grp"] == g]
    _write_svg(f"{outdir}/growth.svg", figures.lines("Features met", {g: [(r["n"], r["mean_features"]) for r in own(g)] for g in groups}, {g: [(r["n"], r["low"], r["high"]) for r in own(g)] for g in groups}))
    _write_svg(f"{outdir}/coverage.svg", figures.bars("Features by number of samples", *_stacked(rows["coverage"], "present_n", "grp", "features")))
    _write_svg(f"{outdir}/composition.svg", figures.bars("Composition", *_stacked(rows["composition"], "grp", "category", "features")))
    update_outputs(f"{folder}/pangenome.json", [f"{outdir}/{name}.{form}" for name in out for form in ("tsv", "svg")], {})
    return out


def update_outputs(path: str, outputs: list[str], parameters: dict) -> None:
    """Metadata of plots: each output is listed once, parameters are those of the last run."""
    meta = read_json(path)
    meta["outputs"] = list(dict.fromkeys([*meta.get("outputs", []), *outputs]))
    if parameters:
        meta["parameters"] = parameters
    write_json(path, meta)
