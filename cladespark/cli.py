"""Command line: ``python -m cladespark.cli COMMAND ...``. Exit code 1 for bad input, 2 for bad options."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from cladespark import config
from cladespark.cohort import Cohort, CohortError, read_cohort, read_sample_list
from cladespark.operators.landscape import checked_parameters

_GIVEN = argparse.SUPPRESS  # options left out stay out of the namespace, so a settings file can decide


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cladespark")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, cohort: bool = False, many: tuple[str, ...] = ()):
        c = sub.add_parser(name)
        c.add_argument("--outdir", default=".")
        if cohort:
            for f in ("--targets", "--off-targets", "--ignore-samples"):
                c.add_argument(f, nargs="+", default=[])
            for f in ("--targets-file", "--off-targets-file", "--ignore-samples-file", "--cohort-file"):
                c.add_argument(f)
        for f in flags:
            c.add_argument(f)
        for f in many:
            c.add_argument(f, action="append", default=[])
        return c

    c = command("scan", "--vcf", "--gfa", "--gfa-index", "--region", "--config", "--bam-manifest", "--mode", "--vcf-engine", cohort=True)
    c.add_argument("--bam", nargs="+", default=[])
    c.add_argument("--require-index", action="store_true")
    c.add_argument("--threads", type=int, default=1)
    for name, kind in _SCAN.items():
        c.add_argument("--" + name.replace("_", "-"), type=kind, default=_GIVEN)
    c.add_argument("--pass-only", action=argparse.BooleanOptionalAction, default=_GIVEN)
    c.add_argument("--no-multiallelic", dest="allow_multiallelic", action="store_false", default=_GIVEN)
    c.add_argument("--same-variant-class-only", action="store_true", default=_GIVEN)
    c = command("compare", "--hits-a", "--hits-b", "--source-a", "--source-b")
    c.add_argument("--overlap-mode", choices=("any", "reciprocal", "contained"), default="contained")
    c.add_argument("--min-reciprocal-overlap", type=float, default=0.5)
    c.add_argument("--breakpoint-tolerance-bp", type=int, default=200)
    c.add_argument("--require-state-compatibility", action="store_true")
    c.add_argument("--no-normalize-contigs", action="store_true")
    c = command("landscape", "--vcf", "--vcf-engine", cohort=True)
    for name, (kind, default) in _LANDSCAPE.items():
        c.add_argument("--" + name.replace("_", "-"), type=kind, default=default)
    c.add_argument("--pass-only", action=argparse.BooleanOptionalAction, default=True)
    c.add_argument("--biallelic-only", action="store_true")
    c.add_argument("--require-active-alt", action="store_true")
    c.add_argument("--local-pca", action="store_true")
    c = command("pangenome", "--vcf", "--gfa", cohort=True)
    c.add_argument("--permutations", type=int, default=100)
    c.add_argument("--seed", type=int, default=42)
    command("annotate", "--hits", "--gff", "--contig-alias")
    c = command("export", "--hits", "--regions", "--track-name")
    c.add_argument("--format", choices=("bed", "gff3"), default="bed")
    c.add_argument("--kind", choices=("hits", "regions", "both"), default="both")
    c = command("report", "--hits", "--regions", "--evidence", "--qc", "--compare", "--run", "--title")
    c.add_argument("--top-n", type=int, default=20)
    c.add_argument("--no-html", action="store_true")
    c = command("plot", "--hits", "--evidence", "--compare", "--landscape", "--pangenome")
    c.add_argument("--plot-type", default="all")
    c.add_argument("--top-n", type=int, default=30)
    c = command("interactive", "--scan-dir", "--landscape-dir", "--pangenome-dir", "--vcf", "--sites-tsv", "--gff3", "--functional-tsv", "--variant-type", many=("--focus", "--track-gff", "--keyword-group", "--sample-abbrev"))
    c.add_argument("--samples", nargs=3, metavar=("OFFTARGET", "DERIVED", "DONOR"))
    for name, default in _PAGES.items():
        c.add_argument("--" + name.replace("_", "-"), type=int, default=default)
    c.add_argument("--pass-only", action=argparse.BooleanOptionalAction, default=True)
    c.add_argument("--require-all-called", action=argparse.BooleanOptionalAction, default=True)
    c.add_argument("--biallelic-only", action="store_true")
    c.add_argument("--title")
    command("index", "--gfa")
    c = command("private-positions", "--vcf", "--xmfa", "--ref-sid", "--assemblies", "--ref", "--chrom", "--out-prefix")
    c.add_argument("--targets", nargs="+", required=True)
    c.add_argument("--start", type=int)
    c.add_argument("--end", type=int)
    return p


#: Options of a scan that a settings file may give too, by part.
_SCAN = {"min_target_support": float, "max_off_target_support": float, "relaxed_target_missing": float, "relaxed_offtarget_missing": float, "min_qual": float, "merge_distance": int, "min_segment_length": int, "bam_min_depth": int, "bam_min_alt_count": int, "bam_min_alt_fraction": float, "bam_min_mapq": int, "bam_min_baseq": int, "discovery_weight": float, "support_weight": float, "penalty_weight": float}
_PLACES = {"scan": ("min_target_support", "max_off_target_support", "relaxed_target_missing", "relaxed_offtarget_missing", "min_qual", "merge_distance", "pass_only", "allow_multiallelic", "same_variant_class_only"), "gfa": ("min_segment_length",), "scoring": ("discovery_weight", "support_weight", "penalty_weight")}
_READS = {"bam_min_depth": "min_depth", "bam_min_alt_count": "min_alt_count", "bam_min_alt_fraction": "allele_fraction_min", "bam_min_mapq": "min_mapq", "bam_min_baseq": "min_baseq"}
_LANDSCAPE = {
    "window_records": (int, 200), "step_records": (int, 50), "window_bp": (int, None), "step_bp": (int, None), "min_qual": (float, None), "variant_type": (str, "all"), "max_site_missing_rate": (float, None), "min_alt_carriers": (int, 0), "min_alt_carrier_freq": (float, None), "max_alt_carrier_freq": (float, None),
    "rare_max_count": (int, 1), "rare_max_freq": (float, 0.05), "min_called_for_freq": (int, 10), "min_freq_values": (int, 10), "min_background_similarity": (float, 0.65), "min_introgression_similarity": (float, None), "min_introgression_delta": (float, 0.05), "max_introgression_missing_rate": (float, 0.5), "min_introgression_windows": (int, 10),
}
_PAGES = {"promoter_bp": 2000, "sv_size_threshold": 50, "candidate_limit": 500, "max_hits": 5000, "max_regions": 1000, "max_windows": 20_000, "max_blocks": 5000, "max_features": 10_000}


def _cohort(a: argparse.Namespace) -> tuple[list[str], list[str], list[str]]:
    """Names given on the command line come before those from files."""
    groups = [list(a.targets), list(a.off_targets), list(a.ignore_samples)]
    for names, path in zip(groups, (a.targets_file, a.off_targets_file, a.ignore_samples_file)):
        if path:
            names += read_sample_list(path)
    if a.cohort_file and not groups[0]:
        c = read_cohort(a.cohort_file)
        groups = [list(c.targets), list(c.off_targets), list(c.ignored)]
    return groups[0], groups[1], groups[2]


def _settings(a: argparse.Namespace) -> config.Settings:
    given = {part: {n: getattr(a, n) for n in names if hasattr(a, n)} for part, names in _PLACES.items()}
    given["bam"] = {to: getattr(a, name) for name, to in _READS.items() if hasattr(a, name)}
    return config.load(a.config, given | ({"mode": a.mode} if a.mode else {}))


def _scan(spark: SparkSession, a: argparse.Namespace) -> int:
    from cladespark import runs
    from cladespark.operators.kernel import Thresholds
    from cladespark.sources import sam, vcf

    if not (a.vcf or a.gfa):
        print("scan needs --vcf or --gfa", file=sys.stderr)
        return 2
    if a.gfa_index and not a.gfa:
        raise ValueError("--gfa-index needs --gfa")
    if a.threads > 1:
        print("--threads has no meaning here: Spark runs in parallel anyway", file=sys.stderr)
    settings, cohort = _settings(a), Cohort.of(*_cohort(a))
    s = settings.scan
    common = {"rules": Thresholds(s.min_target_support, s.max_off_target_support, s.relaxed_target_missing, s.relaxed_offtarget_missing), "weights": settings.scoring.weights(), "settings": settings}
    both = bool(a.vcf and a.gfa)
    if a.vcf:
        if a.require_index:
            vcf.require_index(spark, a.vcf)
        files = sam.sample_pairs(spark, a.bam, a.bam_manifest)
        runs.scan_vcf(spark, a.vcf, cohort, f"{a.outdir}/vcf" if both else a.outdir, a.region, s.merge_distance, s.same_variant_class_only, files, pass_only=s.pass_only, min_qual=s.min_qual, allow_multiallelic=s.allow_multiallelic, **common)
    if a.gfa:
        runs.scan_gfa(spark, a.gfa, cohort, f"{a.outdir}/gfa" if both else a.outdir, a.gfa_index, a.region, s.merge_distance, settings.gfa.min_segment_length, **common)
    if both:
        runs.compare(spark, f"{a.outdir}/vcf/hits.tsv", f"{a.outdir}/gfa/hits.tsv", f"{a.outdir}/compare", settings.compare)
    return 0


def _landscape(spark: SparkSession, a: argparse.Namespace) -> int:
    from cladespark import runs

    checked_parameters(**{n: getattr(a, n) for n in _LANDSCAPE})
    t, o, i = _cohort(a)
    similar = a.min_background_similarity if a.min_introgression_similarity is None else a.min_introgression_similarity
    introgression = {"min_similarity": similar, "min_delta": a.min_introgression_delta, "max_missing": a.max_introgression_missing_rate, "min_windows": a.min_introgression_windows}
    filters = {"pass_only": a.pass_only, "min_qual": a.min_qual, "variant_types": None if a.variant_type == "all" else (a.variant_type,), "biallelic_only": a.biallelic_only, "max_missing_rate": a.max_site_missing_rate, "require_active_alt": a.require_active_alt, "min_carriers": a.min_alt_carriers or None, "min_freq": a.min_alt_carrier_freq, "max_freq": a.max_alt_carrier_freq}
    runs.landscape_vcf(spark, a.vcf, t, a.outdir, o or None, i, a.window_records, a.step_records, a.min_called_for_freq, a.min_freq_values, a.min_background_similarity, introgression, a.local_pca, a.window_bp, a.step_bp, a.rare_max_count, a.rare_max_freq, **filters)
    return 0


def _pairs(values: list[str], option: str, form: str) -> list[tuple[str, str]]:
    out = []
    for v in values:
        name, sep, rest = v.partition("=")
        if not sep or not name.strip() or not rest.strip():
            raise ValueError(f"{option} takes {form}")
        out.append((name.strip(), rest.strip()))
    if len({n for n, _ in out}) < len(out):
        raise ValueError(f"{option}: a name is given twice")
    return out


def _interactive(spark: SparkSession, a: argparse.Namespace) -> int:
    from cladespark import dashboards, focus_runs

    done = 0
    os.makedirs(a.outdir, exist_ok=True)
    for name, folder, make in (
        ("scan", a.scan_dir, lambda d: dashboards.scan_payload(spark, d, a.max_hits, a.max_regions)),
        ("landscape", a.landscape_dir, lambda d: dashboards.landscape_payload(spark, d, a.max_windows, a.max_blocks)),
        ("pangenome", a.pangenome_dir, lambda d: dashboards.pangenome_payload(spark, d, a.max_features)),
    ):
        if folder:
            dashboards.write_page(make(folder), f"{a.outdir}/{name}.html", a.title or name)
            done += 1
    if a.focus:
        if not a.samples:
            print("--focus needs --samples OFFTARGET DERIVED DONOR", file=sys.stderr)
            return 2
        if not (a.vcf or a.sites_tsv):
            print("--focus needs --vcf or --sites-tsv", file=sys.stderr)
            return 2
        groups = {n: tuple(t.strip() for t in terms.split(",") if t.strip()) for n, terms in _pairs(a.keyword_group, "--keyword-group", "NAME=term1,term2")}
        names = {sample: short for short, sample in _pairs(a.sample_abbrev, "--sample-abbrev", "ABBR=SAMPLE")}
        focus_runs.pages(spark, a.focus, tuple(a.samples), a.outdir, a.vcf, a.sites_tsv, a.gff3, _pairs(a.track_gff, "--track-gff", "LABEL=PATH"), a.functional_tsv, groups, names, a.promoter_bp, a.sv_size_threshold, a.candidate_limit, a.pass_only, a.require_all_called, a.variant_type or "all", a.biallelic_only)
        done += 1
    if not done:
        print("interactive needs --focus, --scan-dir, --landscape-dir or --pangenome-dir", file=sys.stderr)
        return 2
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    from cladespark import runs
    from cladespark.cohort import inferred_groups
    from cladespark.operators.compare import CompareRules
    from cladespark.sources import gfa, vcf

    spark = spark or SparkSession.builder.master(a.master).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.command == "scan":
            return _scan(spark, a)
        if a.command == "landscape":
            return _landscape(spark, a)
        if a.command == "interactive":
            return _interactive(spark, a)
        if a.command == "compare":
            rules = CompareRules(a.overlap_mode, a.min_reciprocal_overlap, a.breakpoint_tolerance_bp, a.require_state_compatibility, not a.no_normalize_contigs)
            runs.compare(spark, a.hits_a, a.hits_b, a.outdir, rules, a.source_a, a.source_b)
        elif a.command == "pangenome":
            t, o, i = _cohort(a)
            if a.gfa:
                graph = gfa.read_gfa(spark, a.gfa)
                names, matrix = gfa.samples(graph), runs.gfa_matrix(graph)
            else:
                names, _ = vcf.header(spark, a.vcf)
                matrix = runs.vcf_matrix(vcf.read_vcf(spark, a.vcf), names)
            runs.pangenome_tables(*matrix, inferred_groups(names, t, o or None, i), a.outdir, a.permutations, a.seed)
        elif a.command == "annotate":
            runs.annotate_hits(spark, a.hits, a.gff, a.outdir, a.contig_alias)
        elif a.command == "export":
            runs.export_all(spark, a.outdir, a.hits, a.regions, a.kind, a.format, a.track_name)
        elif a.command == "report":
            runs.report(spark, a.hits, a.outdir, a.evidence, a.top_n, a.regions, a.qc, a.compare, a.run, not a.no_html, title=a.title or "Report")
        elif a.command == "plot":
            if a.landscape:
                runs.landscape_plot_tables(spark, a.landscape, a.outdir)
            if a.pangenome:
                runs.pangenome_plot_tables(spark, a.pangenome, a.outdir)
            if a.hits:
                runs.plot_tables(spark, a.hits, a.outdir, a.plot_type, a.evidence, a.compare, a.top_n)
        elif a.command == "private-positions":
            from cladespark.private_runs import private_positions

            if sum(map(bool, (a.vcf, a.xmfa, a.assemblies))) != 1 or (a.xmfa and not a.ref_sid) or (a.assemblies and not a.ref) or not a.out_prefix:
                print("private-positions needs --out-prefix and one of --vcf, --xmfa with --ref-sid, --assemblies with --ref", file=sys.stderr)
                return 2
            private_positions(spark, a.out_prefix, tuple(a.targets), (a.chrom, a.start, a.end), vcf_path=a.vcf, xmfa_path=a.xmfa, reference=a.ref_sid, assemblies=a.assemblies, fasta=a.ref)
        elif a.command == "index":
            gfa.write_index(gfa.scan_index(gfa.read_gfa(spark, a.gfa, length_from_tag=True)), gfa.default_index(a.gfa), a.gfa)
    except CohortError as e:
        print(e, file=sys.stderr)
        return 2
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
