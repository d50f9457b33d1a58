"""Golden values of the genomic commands on small files written here."""

from __future__ import annotations

import csv
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark import runs, scan
from cladespark.cohort import Cohort, CohortError, inferred_groups, read_cohort, read_sample_list, role_of
from cladespark.functions.rounding import fixed, half_even
from cladespark.operators import compare as cmp
from cladespark.operators import focus, kernel, landscape, pangenome, private_sites
from cladespark.operators.intervals import gaps_between, merge_loci, range_join, region_rollup, union_of_intervals
from cladespark.operators.ordering import global_row_number
from cladespark.operators.windows import bp_windows, record_index, record_windows
from cladespark.sources import gfa, gff, sam, vcf, xmfa
from cladespark.sources.text import parse_region

COHORT = Cohort.of(["F1", "F2"], ["B1", "B2", "B3"])
HEAD = "##fileformat=VCFv4.2\n##contig=<ID=ctgA,length=900>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
# pos, ref, alt, qual, filter, genotypes of F1 F2 B1 B2 B3
RECORDS = [
    (40, "C", "G", 60, "PASS", "0/1 1/1 0/0 0/0 0/0"), (75, "G", "T", 30, "PASS", "1/1 ./. 0/0 0/0 0/0"), (130, "T", "C", 30, ".", "0/1 0|1 0/0 ./. 0/0"),
    (210, "A", "C", 30, "PASS", "0/1 ./. ./. 0/0 0/0"), (260, "C", "A", 90, "PASS", "0/1 0/1 0/0 0/1 0/0"), (333, "G", "A", 30, "lowq", "0/1 0/1 0/0 0/0 0/0"),
    (410, "T", "G", 6, "PASS", "0/1 0/1 0/0 0/0 0/0"), (505, "A", "C,G", 30, "PASS", "0/1 0/1 0/0 0/0 0/0"), (620, "CAT", "C", 60, "PASS", "0/1 0/1 0/0 0/0 0/0"),
]


def rows_of(path):
    with open(path, newline="") as f:
        return list(csv.DictReader(f, delimiter="\t"))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("genomes")
    body = "".join(f"ctgA\t{p}\t.\t{r}\t{a}\t{q}\t{f}\t.\tGT\t" + g.replace(" ", "\t") + "\n" for p, r, a, q, f, g in RECORDS)
    (d / "small.vcf").write_text(HEAD + "F1\tF2\tB1\tB2\tB3\n" + body)
    (d / "donor.vcf").write_text(HEAD + "F1\tF2\tB1\tB2\n" + "".join(f"ctgA\t{p}\t.\tG\tC\t40\tPASS\t.\tGT\t0/1\t1/1\t0/1\t0/0\n" for p in range(15, 135, 20)))
    # two bubbles: n2 or n3 after n1, n5 or n6 further on, where F2 isn't seen
    segments = [("n1", 12, 0), ("n2", 6, 12), ("n3", 9, 12), ("n4", 5, 30), ("n5", 11, 50), ("n6", 11, 50)]
    walks = [(s, ">n1>n2>n4" if s[0] == "F" else ">n1>n3>n4") for s in ("F1", "F2", "B1", "B2", "B3")] + [("F1", ">n5"), *((s, ">n6") for s in ("B1", "B2", "B3"))]
    graph = ["H\tVN:Z:1.1", *(f"S\t{n}\t{'C' * k}\tLN:i:{k}\tSN:Z:ctgA\tSO:i:{o}" for n, k, o in segments), *(f"W\t{s}\t0\tctgA\t0\t61\t{w}" for s, w in walks), "L\tn1\t+\tn4\t+\t0M", "P\tX#1#c\tn1+,n4-\t*"]
    (d / "small.gfa").write_text("\n".join(graph) + "\n")
    line = lambda kind, a, b, s, attr: f"ctgA\tx\t{kind}\t{a}\t{b}\t.\t{s}\t.\t{attr}\n"
    (d / "small.gff3").write_text("##gff-version 3\n" + line("gene", 30, 220, "+", "ID=g1;Name=wx1") + line("mRNA", 30, 220, "+", "ID=t1;Parent=g1") + line("exon", 36, 80, "+", "Parent=t1") + line("CDS", 36, 60, "+", "Parent=t1") + line("five_prime_UTR", 61, 80, "+", "Parent=t1") + line("exon", 120, 140, "+", "Parent=t1") + line("CDS", 120, 125, "+", "Parent=t1") + line("gene", 400, 450, "-", "ID=g2;Name=wx2") + "bad\trow\n")
    return d


@pytest.fixture(scope="module")
def vcf_hits(spark, folder):
    runs.scan_vcf(spark, str(folder / "small.vcf"), COHORT, str(folder / "vcf"))
    return rows_of(folder / "vcf" / "hits.tsv")


def test_vcf_scan(vcf_hits, folder):
    got = {h["locus_id"]: h for h in vcf_hits}
    assert len(got) == len(vcf_hits) == 7
    scores = {int(h["start"]) + 1: (h["strictness_class"], float(h["final_score"])) for h in got.values()}
    # (1 + 1) / 2, 0.2 if complete, QUAL / 60 * 0.1; less 0.8 * (0.4 * missing targets / 2 + 0.3 * missing off-targets / 3)
    assert scores == {40: ("strict_complete", 1.3), 75: ("strict_target_missing", 0.89), 130: ("strict_offtarget_missing", 0.97), 210: ("strict_both_missing", 0.81), 410: ("strict_complete", 1.21), 505: ("strict_complete", 1.25), 620: ("strict_complete", 1.3)}
    assert [int(h["start"]) + 1 for h in vcf_hits] == [40, 620, 505, 410, 130, 75, 210]
    assert got["PPX00000001"]["start"] == "39" and got["PPX00000007"]["end"] == "622" and got["PPX00000007"]["variant_type"] == "indel"
    qc = {r["metric"]: int(r["value"]) for r in rows_of(folder / "vcf" / "qc.tsv")}
    assert [qc[k] for k in ("records_evaluated", "records_skipped_filter", "alleles_evaluated", "alleles_passed", "alleles_contradicted", "strictness_relaxed_threshold", "regions_emitted", "n_target_samples", "n_contigs_scanned")] == [9, 1, 9, 7, 1, 1, 7, 2, 1]
    support = rows_of(folder / "vcf" / "sample_support.tsv")
    assert len(support) == 35 and {r["allele_supported"] for r in support} == {"true", "false"} and {r["depth"] for r in support} == {"NA"}
    evidence = rows_of(folder / "vcf" / "evidence.tsv")
    assert [(r["locus_id"], r["sample_id"], r["evidence_class"], r["metric_name"]) for r in evidence] == [(f"PPX{i:08d}", "", "support", "allele_pattern") for i in range(1, 8)]
    assert evidence[0]["metric_value"] == "1.3" and "all targets support" in evidence[0]["details"]


@pytest.mark.parametrize(("options", "n"), [({"min_qual": 10}, 6), ({"allow_multiallelic": False}, 6), ({"pass_only": False}, 8), ({"rules": kernel.Thresholds(relaxed_target_missing=0.4)}, 7)])
def test_vcf_scan_options(spark, folder, options, n):
    path = str(folder / "small.vcf")
    samples, contigs = vcf.header(spark, path)
    assert scan.scan_vcf(vcf.read_vcf(spark, path), samples, contigs, COHORT, **options).count() == n


def test_region_and_missing_samples(spark, folder):
    path = str(folder / "small.vcf")
    assert vcf.read_vcf(spark, path, "ctgA:75-260").count() == 4
    assert vcf.read_vcf(spark, path, "ctgA:bad").count() == 9 and parse_region("a:1,000-2,000") == ("a", 999, 2000)
    with pytest.raises(CohortError):
        scan.vcf_alleles(vcf.read_vcf(spark, path), ["F1", "F2"], COHORT)
    far = Cohort.of(["F1", "F2"], ["B1", "B2", "B3", "nobody"])
    samples, contigs = vcf.header(spark, path)
    got = scan.scan_vcf(vcf.read_vcf(spark, path), samples, contigs, far).filter("pos = 40").first()
    assert (got["offtarget_missing_n"], got["strictness_class"]) == (1, "strict_offtarget_missing")
    with pytest.raises(FileNotFoundError):
        vcf.require_index(spark, path)
    (folder / "small.vcf.tbi").write_text("")
    vcf.require_index(spark, path)


def test_gfa_scan(spark, folder):
    path = str(folder / "small.gfa")
    hits = runs.scan_gfa(spark, path, COHORT, str(folder / "gfa"))
    got = [(r["locus_id"], r["name"], r["strictness_class"], r["final_score"]) for r in hits.orderBy("rank").collect()]
    assert got == [("GPX00000001", "n2", "strict_complete", 1.2), ("GPX00000002", "n5", "strict_target_missing", 0.84)]
    qc = {r["metric"]: int(r["value"]) for r in rows_of(folder / "gfa" / "qc.tsv")}
    assert qc == {"segments_evaluated": 4, "segments_contradicted": 2, "segments_passed": 2}
    texts = {r["segment_name"]: r["interpretation"] for r in rows_of(folder / "gfa" / "graph_segments.tsv")}
    assert all("do not traverse this same segment" in t for t in texts.values()) and set(texts) == {"n2", "n5"}
    graph = gfa.read_gfa(spark, path)
    assert gfa.samples(graph) == ["B1", "B2", "B3", "F1", "F2", "X"]
    index = gfa.scan_index(graph)
    assert {r["name"] for r in gfa.segments_at(index, "ctgA", 11, 13).collect()} == {"n1", "n2", "n3"}
    assert {r["sample"] for r in gfa.traversing(index, ["n5", "n2"]).collect()} == {"F1", "F2"}
    assert {r["sample"] for r in gfa.present_at(graph, index, "ctgA", 40, 45).collect()} == {"F1", "F2", "B1", "B2", "B3"}  # by their walks


def test_gfa_index(spark, folder, tmp_path):
    import shutil

    path = str(tmp_path / "g.gfa")
    shutil.copy(folder / "small.gfa", path)
    index = str(tmp_path / "other")
    gfa.write_index(gfa.scan_index(gfa.read_gfa(spark, path)), index, path)
    assert scan.gfa_hits(scan.scan_gfa(gfa.read_index(spark, index, path), COHORT)).count() == 2
    with pytest.raises(gfa.GfaError, match="no index"):
        gfa.read_index(spark, str(tmp_path / "nowhere"))
    gfa.write_index(gfa.scan_index(gfa.read_gfa(spark, path)), gfa.default_index(path), path)
    assert gfa.index_for(spark, path)["segments"].inputFiles()[0].startswith(f"file://{gfa.default_index(path)}")
    with open(path, "a") as f:
        f.write("S\tn9\tC\n")
    with pytest.raises(gfa.GfaError, match="another state"):
        gfa.index_for(spark, path)


def test_annotation_and_export(spark, folder, vcf_hits):
    path = str(folder / "vcf" / "hits.tsv")
    runs.annotate_hits(spark, path, str(folder / "small.gff3"), str(folder / "ann"))
    kinds = {int(r["start"]) + 1: (r["annotation_class"], r["gene_id"]) for r in rows_of(folder / "ann" / "annotated_hits.tsv")}
    assert kinds == {40: ("CDS", "wx1"), 75: ("UTR", "wx1"), 130: ("exon", "wx1"), 210: ("intronic", "wx1"), 410: ("intronic", "wx2"), 505: ("intergenic", "NA"), 620: ("intergenic", "NA")}
    assert {r["annotation_class"]: int(r["n_loci"]) for r in rows_of(folder / "ann" / "annotation_summary.tsv")} == {"CDS": 1, "UTR": 1, "exon": 1, "intronic": 2, "intergenic": 2}
    runs.export(spark, path, str(folder / "h.bed"), track="t")
    bed = (folder / "h.bed").read_text().splitlines()
    assert bed[0] == 'track name="t"' and bed[1].split("\t")[:5] == ["ctgA", "39", "40", "PPX00000001", "1000"]
    runs.export(spark, path, str(folder / "h.gff3"), form="gff3")
    line = (folder / "h.gff3").read_text().splitlines()[1].split("\t")
    assert line[3:6] == ["40", "40", "1.3"] and "allele_key=ctgA:40:C:G" in line[8]
    assert runs.export_all(spark, str(folder / "exp"), path, str(folder / "vcf" / "regions.tsv"), form="gff3") == [str(folder / "exp" / f"{k}.gff3") for k in ("hits", "regions")]
    with pytest.raises(FileNotFoundError):
        runs.export_all(spark, str(folder / "exp"), None, None)
    v = folder / "vcf"
    out = runs.report(spark, path, str(folder / "rep"), str(v / "evidence.tsv"), 3, str(v / "regions.tsv"), str(v / "qc.tsv"), run=str(v / "run.json"))
    assert out["ranked_hits"].count() == 3 and os.path.exists(folder / "rep" / "report.md") and "<table>" in (folder / "rep" / "report.html").read_text()
    assert [(r["strictness_class"], r["n_loci"], r["pct_hits"]) for r in out["strictness_summary"].collect()] == [("strict_complete", 4, 57.1), ("strict_target_missing", 1, 14.3), ("strict_offtarget_missing", 1, 14.3), ("strict_both_missing", 1, 14.3), ("relaxed_threshold", 0, 0.0)]
    assert {r["metric"]: r["value"] for r in out["summary"].collect()}["top_locus_id"] == "PPX00000001"
    assert [tuple(r)[:2] for r in out["contradiction_summary"].collect()] == [("alleles_contradicted", "1")]


def test_plot_tables(spark, folder, vcf_hits):
    path, ev = str(folder / "vcf" / "hits.tsv"), str(folder / "vcf" / "evidence.tsv")
    out = runs.plot_tables(spark, path, str(folder / "plots"), evidence=ev)
    assert set(out) == {"locus_panel", "strictness_bar", "score_distribution", "support_bar"}
    assert sum(r["n"] for r in out["score_distribution"].collect()) == 7 and max(r["bin"] for r in out["score_distribution"].collect()) <= 7
    for kind, word in (("support_bar", "--evidence"), ("compare_summary", "--compare"), ("pie", "plot type")):
        with pytest.raises(ValueError, match=word):
            runs.plot_tables(spark, path, str(folder / "plots"), kind)
    runs.plot_tables(spark, path, str(folder / "plots"), "locus_panel", top_n=2)
    import json

    meta = json.loads((folder / "plots" / "plots.json").read_text())
    assert len(meta["outputs"]) == 8 and meta["parameters"] == {"plot_type": "locus_panel", "top_n": 2}


def test_compare(spark, folder, vcf_hits):
    path = str(folder / "vcf" / "hits.tsv")
    rows = runs.compare(spark, path, path, str(folder / "cmp"))
    assert {r["match_class"] for r in rows.filter("overlap > 0").collect()} == {"supported"}
    assert [r["compare_id"] for r in rows.orderBy("n").limit(2).collect()] == ["CMP000001", "CMP000002"]
    one = [("A1", "c#chr1", 100, 200, "strict_complete", 1.0, 0), ("A2", "chr1", 1000, 1010, "strict_complete", 1.0, 1), ("A3", "chr2", 5, 6, "strict_complete", 1.0, 2)]
    two = [("B1", "chr1", 150, 260, "relaxed_threshold", 1.0, 0), ("B2", "chr1", 1100, 1110, "contradicted", 1.0, 1), ("B3", "chr1", 900, 990, "strict_complete", 1.0, 2)]
    ddl = "locus_id string, contig string, start long, end long, strictness_class string, final_score double, ord long"
    a, b = spark.createDataFrame(one, ddl), spark.createDataFrame(two, ddl)
    show = lambda **k: sorted((r["locus_id_a"] or "", r["locus_id_b"] or "", r["match_class"], r["comparison_score"]) for r in cmp.compare(a, b, cmp.CompareRules(**k)).collect())
    assert show() == [("", "B2", "source_specific", 0.3), ("A1", "B1", "supported", 0.5), ("A2", "B3", "partially_supported", 0.005), ("A3", "", "source_specific", 0.3)]
    assert ("A1", "B1", "partially_supported", 0.25) in show(require_state_compatibility=True)
    assert ("A1", "B1", "partially_supported", 0.005) in show(overlap_mode="reciprocal")
    assert ("A1", "B1", "source_specific", 0.3) not in show(normalize_contigs=False) and ("A1", "", "source_specific", 0.3) in show(normalize_contigs=False)


def test_pangenome(spark, folder):
    path = str(folder / "small.vcf")
    samples, _ = vcf.header(spark, path)
    groups = inferred_groups(samples, ["F1", "F2"])
    out = runs.pangenome_tables(*runs.vcf_matrix(vcf.read_vcf(spark, path), samples), groups, str(folder / "pan"), trials=3)
    comp = {(r["grp"], r["category"]): (r["features"], r["bp"]) for r in out["composition"].collect()}
    # ten alleles: one carried by nobody, two by one sample, the others by F1 and F2 (and one by B2 too); the longest letter count of an allele is its length
    want = {"full": [(1, 1), (2, 2), (7, 9), (0, 0)], "target": [(1, 1), (2, 2), (0, 0), (7, 9)], "off_target": [(9, 11), (1, 1), (0, 0), (0, 0)]}
    assert comp == {(g, c): v for g, vs in want.items() for c, v in zip(pangenome.CATEGORIES, vs)}
    graph = gfa.read_gfa(spark, str(folder / "small.gfa"))
    f, p = runs.gfa_matrix(graph)
    comp = {r["category"]: (r["features"], r["bp"]) for r in pangenome.composition(f, p.filter("sample <> 'X'"), groups).filter("grp = 'full'").collect()}
    assert comp == {"absent": (0, 0), "private": (1, 11), "accessory": (3, 26), "core": (2, 17)}


def test_growth_curves_equal_a_loop(spark):
    rng = random.Random(1)
    samples = [f"s{i}" for i in range(6)]
    have = {f: {s for s in samples if rng.random() < 0.4} for f in range(30)}
    features = spark.createDataFrame([(f, f + 1) for f in have], "feature_id long, length_bp long")
    presence = spark.createDataFrame([(f, s) for f, ss in have.items() for s in ss], "feature_id long, sample string")
    groups = {"full": tuple(samples), "target": tuple(samples[:3])}
    got = {(r["grp"], r["trial"], r["n"]): (r["features"], r["bp"], r["new_features"], r["singletons"]) for r in pangenome.growth_curves(features, presence, groups, 3, 42).collect()}
    for g, names in groups.items():
        for trial in (1, 2, 3):
            order = list(names)
            random.Random(42 + trial - 1).shuffle(order)
            seen: set[int] = set()
            for n in range(1, len(order) + 1):
                now = {f for f, ss in have.items() if ss & set(order[:n])}
                single = sum(len(have[f] & set(order[:n])) == 1 for f in now)
                assert got[g, trial, n] == (len(now), sum(f + 1 for f in now), len(now - seen), single)
                seen = now


def test_landscape(spark, folder):
    out = runs.landscape_vcf(spark, str(folder / "donor.vcf"), ["F1", "F2"], str(folder / "land"), ["B1", "B2"], window=3, step=3, min_called=0, min_freq_values=0, introgression={"min_similarity": 0.9, "min_delta": 0.5, "min_windows": 2}, pca=True)
    blocks = out["candidate_introgression_blocks"].collect()
    assert [(b["sample"], b["candidate_donor"], b["n_windows"], b["mean_donor_similarity"], b["mean_similarity_delta"], b["evidence_class"]) for b in blocks] == [("F1", "B1", 2, 1.0, 1.0, "offtarget_closer_than_target")]
    assert [b["block_id"] for b in blocks] == ["IB00000001"] and sorted(r["window_id"] for r in out["windows"].collect()) == ["LW00000001", "LW00000002"]
    pca = out["local_pca"].collect()
    assert len(pca) == 8 and all(0 <= r["local_pc1_variance"] <= 1 for r in pca)
    records = vcf.read_vcf(spark, str(folder / "small.vcf"))
    got = landscape.filter_reason(records, variant_types=("snp",), biallelic_only=True, max_missing_rate=0.25, min_carriers=2, max_freq=0.6)
    counts = {r["skip_reason"]: r["count"] for r in got.groupBy("skip_reason").count().collect()}
    assert counts == {None: 4, "filter": 1, "variant_type": 1, "multiallelic": 1, "site_missing_rate": 1, "min_alt_carriers": 1}


@pytest.mark.parametrize(("n", "size", "step"), [(1, 3, 1), (7, 3, 2), (10, 4, 4), (9, 3, 5), (20, 7, 3)])
def test_record_windows_equal_a_loop(spark, n, size, step):
    df = record_index(spark.range(n).select(F.lit("c").alias("contig"), "id"), ["contig"], "id")
    got = sorted((r["w"], r["i"]) for r in record_windows(df, size, step).collect())
    want, w, start = [], 0, 0
    while start < n:
        want += [(w, i) for i in range(start, min(start + size, n))]
        if start + size >= n:
            break
        w, start = w + 1, start + step
    assert got == want


def test_bp_windows_number_only_filled_ones(spark):
    df = spark.createDataFrame([("c", 100, 101), ("c", 130, 140), ("c", 400, 401)], "contig string, start long, end long")
    assert sorted((r["w"], r["start"]) for r in bp_windows(df, 50, 25).collect()) == [(0, 100), (0, 130), (1, 130), (2, 400)]  # the first window that reaches the end is the last


def test_intervals_equal_brute_force(spark):
    rng = random.Random(3)
    make = lambda k: [(i, rng.choice("xy"), s := rng.randint(0, 3000), s + rng.randint(1, 400)) for i in range(k)]
    a, b = make(150), make(150)
    left = spark.createDataFrame(a, "a_id int, a_contig string, a_start long, a_end long")
    right = spark.createDataFrame(b, "b_id int, b_contig string, b_start long, b_end long")
    for tol in (0, 30):
        got = sorted((r["a_id"], r["b_id"]) for r in range_join(left, right, 64, tol).collect())
        ok = lambda p, q, t=tol: p[1] == q[1] and ((q[2] < p[3] and p[2] < q[3]) if t == 0 else (q[2] <= p[3] + t and q[3] >= p[2] - t))
        assert got == sorted((p[0], q[0]) for p in a for q in b if ok(p, q))
    cover = spark.createDataFrame([(c, s, e) for _, c, s, e in a], "contig string, start long, end long")
    merged = union_of_intervals(cover, ["contig"])
    base = {c: np.zeros(4000, bool) for c in "xy"}
    for _, c, s, e in a:
        base[c][s:e] = True
    assert sum(r["end"] - r["start"] for r in merged.collect()) == sum(int(v.sum()) for v in base.values())
    assert all(not base[r["contig"]][r["start"] : r["end"]].any() for r in gaps_between(merged, ["contig"]).collect())


def test_no_window_over_the_rows_of_a_contig(spark):
    """Windows are over stretches; those over a whole contig see one row for each stretch, which an aggregate just made."""
    import re

    from cladespark.operators.annotate import nearest_gene
    from cladespark.operators.intervals import consecutive_runs

    df = spark.createDataFrame([("c", 0, 1, "snp", 0, "g")], "contig string, start long, end long, variant_type string, ord long, gene_id string")
    made = {"merge": merge_loci(df), "union": union_of_intervals(df, ["contig"]), "gaps": gaps_between(df, ["contig"]), "runs": consecutive_runs(df, ["contig"], "start"), "index": record_index(df, ["contig"], "start"), "nearest": nearest_gene(df.drop("gene_id"), df)}
    for name, out in made.items():
        lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        windows = [i for i, x in enumerate(lines) if re.search(r"\bWindow \[", x)]
        assert windows, name
        for i in windows:
            if not re.search(r"\], \[[^\]]*_s#\d+L?\]", lines[i]):
                below = next(x for x in lines[i + 1 :] if not re.search(r"\b(Project|Window|Filter)\b", x))
                assert "Aggregate" in below, (name, lines[i], below)


def test_stretches_give_the_same_as_one(spark, monkeypatch):
    """Short stretches, so that runs, unions, gaps and numbers cross many of them."""
    from cladespark.operators import intervals, windows

    rng = random.Random(9)
    rows = [(rng.choice("xy"), s := rng.randint(0, 3000), s + rng.randint(1, 60), rng.choice(["snp", "sv"]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "contig string, start long, end long, variant_type string, ord long")

    def results(width):
        monkeypatch.setattr(intervals, "STRETCH", width)
        monkeypatch.setattr(intervals.stretched, "__defaults__", (width,))
        out = [sorted(map(tuple, merge_loci(df, 5, same).select("ord", "island").collect())) for same in (False, True)]
        merged = union_of_intervals(df, ["contig"])
        out += [sorted(map(tuple, merged.collect())), sorted(map(tuple, gaps_between(merged, ["contig"]).collect()))]
        places = df.select("contig", "start").distinct()
        runs_ = intervals.consecutive_runs(places, ["contig"], "start").groupBy("contig", "island").agg(F.min("start").alias("a"), F.max("start").alias("b"))
        out.append(sorted((r["contig"], r["a"], r["b"]) for r in runs_.collect()))
        out.append(sorted((r["contig"], r["start"], r["i"], r["n"]) for r in windows.record_index(places, ["contig"], "start", width).collect()))
        genes = df.filter("ord % 4 = 0").select(F.format_string("g%04d", "ord").alias("gene_id"), "contig", "start", "end")
        from cladespark.operators.annotate import nearest_gene

        out.append(sorted(map(tuple, nearest_gene(df.filter("ord % 4 = 1"), genes).select("ord", "gene_id", "distance").collect())))
        return out

    assert results(37) == results(1 << 18)


def test_merge_uses_the_previous_end(spark):
    rows = [("c", 0, 100, "snp", 0), ("c", 10, 20, "snp", 1), ("c", 50, 60, "indel", 2), ("d", 55, 56, "snp", 3)]
    df = spark.createDataFrame(rows, "contig string, start long, end long, variant_type string, ord long").withColumns({"strictness_class": F.lit("strict_complete"), "target_missing_n": F.lit(0), "offtarget_support_n": F.lit(0), "final_score": F.lit(1.0)})
    got = lambda *a: sorted((r["contig"], r["start"], r["end"], r["n_loci"]) for r in region_rollup(merge_loci(df, *a)).collect())
    assert got() == [("c", 0, 20, 2), ("c", 50, 60, 1), ("d", 55, 56, 1)]
    assert got(30) == [("c", 0, 60, 3), ("d", 55, 56, 1)] and got(30, True) == [("c", 0, 20, 2), ("c", 50, 60, 1), ("d", 55, 56, 1)]


@pytest.mark.parametrize(
    ("counts", "rules", "want"),
    [
        ((2, 2, 0, 3, 0, 0), {}, ("strict_complete", True)), ((2, 2, 1, 3, 0, 0), {}, ("contradicted", False)), ((2, 2, 1, 3, 0, 0), {"max_offtarget_support": 0.5}, ("strict_complete", True)),
        ((0, 2, 0, 3, 2, 0), {}, ("strict_target_missing", False)), ((0, 2, 0, 3, 2, 1), {}, ("strict_both_missing", False)), ((1, 2, 0, 3, 0, 0), {}, ("relaxed_threshold", False)), ((1, 2, 0, 3, 0, 0), {"min_target_support": 0.5}, ("strict_complete", True)),
        ((1, 2, 0, 3, 1, 0), {}, ("strict_target_missing", True)), ((1, 2, 0, 3, 1, 0), {"relaxed_target_missing": 0.4}, ("relaxed_threshold", True)), ((2, 2, 0, 3, 0, 3), {"relaxed_offtarget_missing": 0.5}, ("relaxed_threshold", True)), ((1, 2, 0, 3, 1, 1), {}, ("strict_both_missing", True)),
    ],
)
def test_strictness(spark, counts, rules, want):
    df = spark.createDataFrame([counts], ", ".join(f"{c} long" for c in kernel.COUNTS))
    r = kernel.classify(df, kernel.Thresholds(**rules)).first()
    assert (r["strictness_class"], r["pattern_pass"]) == want


def test_rounding_equals_python(spark):
    rng = random.Random(5)
    values = [2.675, 0.285, 1.005, 0.5, 1.5, 2.5, -2.5, 0.1234565, 0.25, 1e-9, -0.000001, 123456.789] + [rng.uniform(-3, 3) for _ in range(500)] + [k / 2000 for k in range(200)]
    for digits in (0, 1, 2, 4, 6):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = [(r["v"], r["r"], r["t"]) for r in df.select("v", half_even(F.col("v"), digits).alias("r"), fixed(F.col("v"), digits).alias("t")).collect()]
        assert all(r == round(v, digits) for v, r, _ in got)
        assert all(float(t) == float(f"{v:.{digits}f}") for v, _, t in got)


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.col("id")).repartition(7)
    got = [r["n"] for r in global_row_number(df, "n", F.col("x").desc(), F.col("id"), start=1).orderBy(F.col("x").desc(), "id").collect()]
    assert got == list(range(1, 1001))
    assert global_row_number(df.limit(0), "n", "x").count() == 0


def test_cohorts(tmp_path):
    with pytest.raises(CohortError):
        Cohort.of(["a"], ["a"])
    with pytest.raises(CohortError):
        Cohort.of([], ["a"])
    assert role_of("Off-Target") == "off_target" and inferred_groups(["a", "b", "c"], ["b"], ignored=["c"]) == {"full": ("a", "b"), "target": ("b",), "off_target": ("a",)}
    (tmp_path / "c.tsv").write_text("sample\trole\na\ttarget\nb\tbackground\nc\tignore\na\ttarget\n")
    assert read_cohort(str(tmp_path / "c.tsv")) == Cohort.of(["a"], ["b"], ["c"])
    (tmp_path / "c.yaml").write_text("cohorts:\n  targets: [a]\n  off_targets: [b]\n")
    assert read_cohort(str(tmp_path / "c.yaml")) == Cohort.of(["a"], ["b"])
    (tmp_path / "d.tsv").write_text("sample_id\tcohort_role\na\tTarget\nb\tcomparisons\n\ttarget\nc\tBackgrounds\n")
    assert read_cohort(str(tmp_path / "d.tsv")) == Cohort.of(["a"], ["b", "c"])
    (tmp_path / "l.txt").write_text("# names\n  a  first\n\nb\tx\na\n")
    assert read_sample_list(str(tmp_path / "l.txt")) == ("a", "b")
    with pytest.raises(ValueError, match=".tsv"):
        read_cohort(str(tmp_path / "c.csv"))


def test_reads(spark, tmp_path):
    seq = "ACGTACGTACGTACGTACGTACGTACGTAC"
    line = lambda k, base, cigar="30M", q="I" * 30, flag=0: f"r{k}\t{flag}\tchr1\t86\t60\t{cigar}\t*\t0\t0\t{seq[:14] + base + seq[15:]}\t{q}\n"
    files = {"F1": 12 * [line(0, "T")], "B1": 12 * [line(0, "A")], "B2": 12 * [line(0, "T")], "F2": 3 * [line(0, "T")], "B3": [*12 * [line(0, "A", "10M2D20M")], line(1, "T", flag=256), line(2, "T", q="!" * 30)]}
    blocks = None
    for s, body in files.items():
        (tmp_path / f"{s}.sam").write_text(f"@RG\tID:1\tSM:{s}\n" + "".join(body))
        assert sam.sample_name(spark, str(tmp_path / f"{s}.sam")) == s
        own = sam.aligned_blocks(sam.read_sam(spark, str(tmp_path / f"{s}.sam"), s))
        blocks = own if blocks is None else blocks.unionByName(own)
    loci = spark.createDataFrame([(0, "chr1", 99, 100, "A", "T", "snp"), (1, "chr1", 90, 95, "AAAAA", "A", "indel"), (2, "chr9", 1, 2, "A", "T", "snp")], "ord long, contig string, start long, end long, ref string, alt string, variant_type string")
    counts = sam.allele_counts(loci, blocks, list(files))
    ev = {(r["ord"], r["sample"]): r for r in sam.read_evidence(counts, ("F1", "F2")).collect()}
    assert len(ev) == 15
    assert [(ev[0, s]["depth"], ev[0, s]["alt_n"], ev[0, s]["evidence_class"]) for s in ("F1", "B1", "B2", "F2")] == [(12, 12, "support"), (12, 0, "absence"), (12, 12, "contradiction"), (3, 3, "uninformative")]
    assert ev[0, "B3"]["alt_n"] == 0 and ev[1, "F1"]["depth"] == 12 and ev[1, "F1"]["evidence_class"] == "uninformative" and ev[2, "F1"]["depth"] == 0
    depth = {(r["sample"], r["pos"]): r["depth"] for r in sam.position_depth(blocks, "chr1", 94, 97).collect()}
    assert len(depth) == 15 and depth["F1", 95] == 12 and depth["B3", 95] == 1 and depth["B3", 94] == 13
    assert {r["ord"]: r["support"] for r in sam.locus_support(sam.read_evidence(counts, ("F1", "F2"))).collect()}[0] == pytest.approx((1 + 1 - 1 + 1) / 4)


def test_xmfa(spark, tmp_path):
    (tmp_path / "a.xmfa").write_text("#FormatVersion Mauve1\n#Key=value\n>1:11-18 + ref.fa\nACGTACGT\n>2:1-8 + t1.fa\nATGTA-GT\n>3:1-8 + t2.fa\nATGTA-GT\n>4:1-8 + o1.fa\nACGTACGT\n=\n")
    states = xmfa.reference_states(xmfa.read_xmfa(spark, str(tmp_path / "a.xmfa")), "ref")
    sites = private_sites.judged(private_sites.from_states(states, ("t1", "t2")), 2)
    got = sorted((r["pos"], r["target_allele"], r["strictness"], r["classification"]) for r in sites.collect())
    assert got == [(12, "T", "strict", "snp"), (16, "-", "strict", "indel")]
    assert private_sites.intervals(sites).count() == 2


def test_private_sites(spark):
    rows = [(1, "A", ["T"], [[1, 1], [1, None], [0, 0]]), (2, "A", ["T"], [[1, 1], [0, 1], [0, 0]]), (3, "A", ["T"], [[1, 1], [1, 1], [1, 1]]), (4, "A", ["TG"], [[1, 1], [1, 1], [0, 1]]), (5, "A", ["T"], [[1, 1], [0, 0], [0, 0]]), (6, "A", ["T"], [[1, 1], [1, 1], None])]
    df = spark.createDataFrame([("c", *r) for r in rows], "contig string, pos long, ref string, alts array<string>, gts array<array<int>>")
    sites = private_sites.judged(private_sites.from_vcf(df, ["t1", "t2", "o"], ("t1", "t2")), 2)
    assert sorted((r["pos"], r["strictness"], r["classification"], r["n_targets_observed"]) for r in sites.collect()) == [(1, "strict", "snp", 2), (2, "target_partial", "snp", 1)]
    runs_ = private_sites.intervals(sites).collect()
    assert [(r["start"], r["end"], r["strictness"], r["n_targets_observed"]) for r in runs_] == [(1, 2, "target_partial", 1)]
    variants = spark.createDataFrame([("c", 5, "t1", "A", "T"), ("c", 9, "o", "G", "-")], "contig string, pos long, sample string, ref string, alt string")
    coverage = spark.createDataFrame([("t2", "c", 1, 6), ("o", "c", 1, 20), ("t1", "c", 1, 20)], "sample string, contig string, start long, end long")
    states = private_sites.assembly_states(variants, coverage, ("t1", "t2", "o"))
    assert sorted((r["pos"], r["sample"], r["state"]) for r in states.collect()) == [(5, "o", "A"), (5, "t1", "T"), (5, "t2", "A"), (9, "o", "-"), (9, "t1", "G")]
    assert [(r["pos"], r["strictness"]) for r in private_sites.judged(private_sites.from_states(states, ("t1", "t2")), 2).collect()] == [(9, "target_partial")]


def test_focus(spark, folder):
    assert focus.parse_focus("chr1:1,000-2,000") == ("chr1", 1000, 2000)
    with pytest.raises(ValueError, match="not a region"):
        focus.parse_focus("chr1")
    path = str(folder / "donor.vcf")
    samples, _ = vcf.header(spark, path)
    rows = focus.focus_sites(vcf.read_vcf(spark, path), samples, "F1", "B1", "B2").collect()
    assert len(rows) == 6 and {(r["pattern_class"], r["derived_state"], tuple(r["shared_private_alts"]), r["display_type"]) for r in rows} == {("target_private", "het", (1,), "SNP")}
    feats = gff.read_gff(spark, str(folder / "small.gff3")).select(F.lit("g").alias("gene_id"), "type", (F.col("start") + 1).alias("start"), "end", "strand").filter("end <= 220")
    parts = {(r["part"], r["start"], r["end"]) for r in focus.gene_models(feats, 20).collect()}
    assert {("intron", 81, 119), ("promoter", 10, 29), ("cds", 36, 60), ("exon", 120, 140), ("gene", 30, 220)} <= parts


def test_growth_quantiles_rest_on_100_trials(spark, monkeypatch):
    from cladespark.plans import catalogue

    seen, curves = [], catalogue.pangenome.growth_curves
    monkeypatch.setattr(catalogue.pangenome, "growth_curves", lambda *a: seen.append(curves(*a)) or seen[-1])
    assert catalogue.QUERIES["growth_quantiles"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen[0].select("trial").distinct().count() == 100


def test_every_event_is_annotated(spark):
    from collections import Counter

    from cladespark.plans.catalogue import QUERIES
    from cladespark.plans.driver_tables import events

    sf = "/root/testdata/sf0.001"
    got = {name: QUERIES[name](spark, sf).collect() for name in ("annotate_hierarchy", "annotation_summary", "annotate_nearest", "candidate_rank")}
    rows = events(spark, sf).collect()
    loci, others = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
    classes, nearest, burden = {}, {}, Counter()
    meets = lambda a, b, more: a["contig"] == b["contig"] and a["start"] < b["end"] + more and b["start"] < a["end"]
    for a in loci:
        genes = [b for b in others if meets(a, b, 300)]
        kinds = {b["ord"] % 3 for b in others if meets(a, b, 0)}
        name = "intergenic" if not genes else "CDS" if 0 in kinds else "UTR" if 1 in kinds else "exon" if kinds else "intronic"
        classes[a["locus_id"]] = (min(genes, key=lambda b: (b["start"], b["ord"]))["locus_id"] if genes else None, name)
        for b in genes:
            burden[b["start"], b["locus_id"]] += (1, 2, 4)[a["ord"] % 3]
        near = [(max(0, b["start"] - (a["end"] - 1), a["start"] - (b["end"] + 299)), b["start"], b["end"], b["locus_id"]) for b in others if b["contig"] == a["contig"]]
        nearest[a["locus_id"]] = min(near, default=(None, 0, 0, None))
    assert {r["locus_id"]: (r["gene_id"], r["annotation_class"]) for r in got["annotate_hierarchy"]} == classes and len(got["annotate_hierarchy"]) == len(loci)
    assert {r["annotation_class"]: r["n_loci"] for r in got["annotation_summary"] if r["n_loci"]} == Counter(name for _, name in classes.values())
    assert {r["locus_id"]: (r["distance"], r["gene_id"]) for r in got["annotate_nearest"]} == {i: (x[0], x[3]) for i, x in nearest.items()}
    best = sorted(burden.items(), key=lambda x: (-x[1], x[0]))[:50]
    assert [(r["rank"], r["gene_id"], r["rank_score"]) for r in sorted(got["candidate_rank"], key=lambda r: r["rank"])] == [(i, k[1], n) for i, (k, n) in enumerate(best, 1)]


def test_queries_need_no_session_to_be_listed():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dashboards_and_plot_data(spark, folder, vcf_hits):
    from cladespark import dashboards
    from cladespark.operators import plot_data

    (folder / "scan").mkdir()
    os.symlink(folder / "vcf", folder / "scan" / "vcf")
    payload = dashboards.scan_payload(spark, str(folder / "scan"), hits=3)
    assert payload["n_hits"] == 7 and len(payload["sources"][0]["hits"]) == 3 and payload["sources"][0]["best_score"] == 1.3
    dashboards.write_page(payload, str(folder / "page.html"))
    assert dashboards.read_json(str(folder / "page.json"))["n_hits"] == 7 and dashboards.read_json("/nowhere.json") == {}
    pairs = spark.createDataFrame([("c", 0, "a", "b", 0.2), ("c", 0, "a", "c", 0.9), ("c", 0, "b", "c", 0.1)], "contig string, w int, sample_a string, sample_b string, similarity double")
    order, matrix = plot_data.leaf_order(plot_data.mean_similarity(pairs), ["a", "b", "c"])
    assert order == ["a", "c", "b"] and matrix[0, 1] == 0.9
    assert sorted(["chr10", "chr2", "x"], key=plot_data.contig_key) == ["chr2", "chr10", "x"]


def test_cli(spark, folder):
    from cladespark.cli import main

    base = ["--targets", "F1", "F2", "--off-targets", "B1", "B2", "B3"]
    out, small = str(folder / "cli"), str(folder / "small.vcf")
    assert main(["scan", "--vcf", small, "--gfa", str(folder / "small.gfa"), "--outdir", out, *base], spark) == 0
    assert {r["match_class"] for r in rows_of(folder / "cli" / "compare" / "compare.tsv")} <= {"supported", "partially_supported", "source_specific", "contradicted"}
    assert main(["scan", "--outdir", out, *base], spark) == 2
    assert main(["scan", "--vcf", small, "--outdir", out, "--targets", "F1", "--off-targets", "F1"], spark) == 2
    assert main(["scan", "--vcf", small, "--outdir", out, "--gfa-index", "x", *base], spark) == 1
    assert main(["scan", "--vcf", small, "--outdir", out, "--mode", "private_genotype", *base], spark) == 1
    assert main(["index", "--gfa", str(folder / "small.gfa")], spark) == 0 and os.path.isdir(f"{folder}/small.gfa.index")


def test_settings_file_and_options(spark, folder, tmp_path):
    import json

    from cladespark import config
    from cladespark.cli import main

    (tmp_path / "c.yaml").write_text("project_name: trial\nscan:\n  min_qual: 10\n  merge_distance: 7\nscoring:\n  penalty_weight: 0.5\nunknown: 1\n")
    s = config.load(str(tmp_path / "c.yaml"), {"scan": {"merge_distance": 9}})
    assert (s.project_name, s.scan.min_qual, s.scan.merge_distance, s.scan.pass_only, s.scoring.penalty_weight, s.scoring.support_weight) == ("trial", 10, 9, True, 0.5, 0.7)
    for bad in ({"scan": {"min_target_support": 2}}, {"bam": {"min_depth": -1}}, {"mode": "private_sv_state"}, {"gfa": {"min_segment_length": 0}}, {"scan": 3}):
        with pytest.raises(ValueError, match="must|mode"):
            config.load(None, bad)
    args = ["scan", "--vcf", str(folder / "small.vcf"), "--config", str(tmp_path / "c.yaml"), "--outdir", str(tmp_path / "o"), "--targets", "F1", "F2", "--off-targets", "B1", "B2", "B3"]
    assert main(args, spark) == 0 and len(rows_of(tmp_path / "o" / "hits.tsv")) == 6
    run = json.loads((tmp_path / "o" / "run.json").read_text())
    assert run["project_name"] == "trial" and run["config"]["scan"]["min_qual"] == 10 and run["version"]
    assert {float(r["penalty_score"]) for r in rows_of(tmp_path / "o" / "hits.tsv") if r["strictness_class"] == "strict_target_missing"} == {0.1}
    assert main([*args, "--min-qual", "0"], spark) == 0 and len(rows_of(tmp_path / "o" / "hits.tsv")) == 7


def test_scan_with_reads(spark, folder, tmp_path):
    from cladespark.cli import main

    def sam_file(name, sample, base, n, flag=0):
        read = "A" * 9 + base + "A" * 10  # covers 31..50; base 40 is the tenth
        body = "".join(f"r{k}\t{flag}\tctgA\t31\t60\t20M\t*\t0\t0\t{read}\t{'I' * 20}\n" for k in range(n))
        body += "".join(f"i{k}\t0\tctgA\t615\t60\t20M\t*\t0\t0\t{'A' * 20}\t{'I' * 20}\n" for k in range(9))
        (tmp_path / name).write_text((f"@RG\tID:1\tSM:{sample}\n" if sample else "@HD\tVN:1.6\n") + body)
        return str(tmp_path / name)

    files = [sam_file("a.sam", "F1", "G", 10), sam_file("F2.sam", None, "C", 10), sam_file("b.sam", "B1", "C", 12), sam_file("c.sam", "B2", "G", 3)]
    base = ["--vcf", str(folder / "small.vcf"), "--targets", "F1", "F2", "--off-targets", "B1", "B2", "B3"]
    assert main(["scan", *base, "--outdir", str(tmp_path / "o"), "--bam", *files], spark) == 0
    hits = {int(r["start"]) + 1: r for r in rows_of(tmp_path / "o" / "hits.tsv")}
    # F1 supports (1), F2 is ambiguous (0.3), B1 lacks the allele (1), B2 has too few reads: mean 0.766667, times 0.7
    assert float(hits[40]["support_score"]) == 0.536667 and float(hits[40]["final_score"]) == 1.836667 and float(hits[75]["support_score"]) == 0
    bam = [r for r in rows_of(tmp_path / "o" / "evidence.tsv") if r["source_type"] == "bam"]
    assert len(bam) == 7 * 4
    at = {r["sample_id"]: r for r in bam if r["locus_id"] == hits[40]["locus_id"]}
    assert {s: (r["evidence_class"], r["metric_name"], r["metric_value"]) for s, r in at.items()} == {"F1": ("support", "allele_fraction", "1.0"), "F2": ("ambiguous", "allele_fraction", "0.0"), "B1": ("absence", "allele_fraction", "0.0"), "B2": ("uninformative", "allele_fraction", "1.0")}
    indel = next(r for r in bam if r["locus_id"] == hits[620]["locus_id"] and r["sample_id"] == "F1")
    assert (indel["evidence_class"], indel["metric_name"], indel["metric_value"], indel["details"]) == ("uninformative", "depth", "9.0", "BAM pileup at ctgA:619")
    support = {(r["locus_id"], r["sample_id"]): (r["depth"], r["allele_fraction"]) for r in rows_of(tmp_path / "o" / "sample_support.tsv")}
    assert support[hits[40]["locus_id"], "F1"] == ("10", "1.0") and support[hits[620]["locus_id"], "F1"] == ("9", "NA") and support[hits[40]["locus_id"], "B3"] == ("NA", "NA")
    (tmp_path / "m.tsv").write_text("# a comment\nbam_path\tsample_id\tgroup\n" + f"{files[0]}\tB1\tx\n")
    assert sam.sample_pairs(spark, files, str(tmp_path / "m.tsv")) == [(files[0], "B1")]
    (tmp_path / "n.tsv").write_text("path\tsample_id\n")
    with pytest.raises(ValueError, match="bam_path"):
        sam.read_manifest(str(tmp_path / "n.tsv"))


def test_landscape_command(spark, folder, tmp_path):
    from cladespark.cli import main

    base = ["landscape", "--vcf", str(folder / "small.vcf"), "--targets", "F1", "F2", "--off-targets", "B1", "B2", "B3", "--outdir", str(tmp_path / "l")]
    for bad in (["--window-records", "0"], ["--max-site-missing-rate", "2"], ["--variant-type", "cnv"], ["--min-alt-carrier-freq", "0.6", "--max-alt-carrier-freq", "0.5"], ["--min-introgression-windows", "0"]):
        assert main([*base, *bad], spark) == 1
    assert main([*base, "--window-bp", "200", "--step-bp", "100", "--variant-type", "snp", "--biallelic-only", "--min-alt-carriers", "2", "--local-pca"], spark) == 0
    got = {r["metric"]: r["value"] for r in rows_of(tmp_path / "l" / "filter_summary.tsv")}
    assert list(got) == [name for name, _ in landscape.FILTER_METRICS]
    # seen, then: one FILTER, one with two ALTs, one indel, two with a single carrier
    assert [got[k] for k in ("records_seen", "records_kept", "skipped_filter", "skipped_multiallelic", "skipped_variant_type", "skipped_min_alt_carriers", "kept_fraction")] == ["9", "4", "1", "1", "1", "2", "0.444444"]
    windows = rows_of(tmp_path / "l" / "windows.tsv")
    # kept: 40, 130, 260, 410 (0-based 39..410): grid from 39; windows that hold records, the last reaches 410
    assert [(r["window_id"], int(r["start"]), int(r["end"]), int(r["n_variants"])) for r in windows] == [("LW00000001", 39, 130, 2), ("LW00000002", 259, 260, 1), ("LW00000003", 259, 410, 2)]
    assert main(["plot", "--landscape", str(tmp_path / "l"), "--outdir", str(tmp_path / "p")], spark) == 0
    cells = rows_of(tmp_path / "p" / "cluster_map.tsv")
    assert len(cells) == 25 and all(float(r["similarity"]) == 1 for r in cells if r["row"] == r["column"])
    (tmp_path / "mixed.vcf").write_text(HEAD + "F1\tB1\n" + "".join(f"{c}\t{p}\t.\tG\tC\t4\tPASS\t.\tGT\t0/1\t0/0\n" for c, p in (("x", 1), ("y", 1), ("x", 2))))
    assert main(["landscape", "--vcf", str(tmp_path / "mixed.vcf"), "--targets", "F1", "--off-targets", "B1", "--outdir", str(tmp_path / "m")], spark) == 1


def test_interactive_command(spark, folder, tmp_path, vcf_hits):
    import json

    from cladespark.cli import main

    (tmp_path / "f.tsv").write_text("gene\tproduct\nwx1\tWaxy kinase\n")
    args = ["interactive", "--vcf", str(folder / "small.vcf"), "--gff3", str(folder / "small.gff3"), "--functional-tsv", str(tmp_path / "f.tsv"), "--samples", "B1", "F1", "F2", "--promoter-bp", "10", "--keyword-group", "Kinases!=kinase,other", "--sample-abbrev", "bg=B1", "--track-gff", f"extra={folder}/small.gff3", "--outdir", str(tmp_path / "i")]
    assert main([*args, "--focus", "ctgA:1-300", "--focus", "ctgA:301-700", "--scan-dir", str(folder / "vcf")], spark) == 0
    page = json.loads((tmp_path / "i" / "ctgA_1_300.json").read_text())
    # 75 and 210 lack a genotype of F2; 40 differs between the targets; at 130 and 260 both share what B1 lacks
    assert page["counters"] == {"records_seen": 5, "records_written": 3, "skipped_filter": 0, "skipped_variant_type": 0, "skipped_missing": 2, "skipped_biallelic": 0}
    assert page["patterns"] == {"target_private": 2, "other": 1}
    genes = {(r["feature_type"], r["start"], r["end"]): (r["snp_n"], r["functional"]) for r in page["features"]}
    assert genes["gene", 30, 220] == (1, "Waxy kinase") and genes["exon", 120, 140] == (1, "Waxy kinase") and genes["promoter", 20, 29][0] == 0 and genes["CDS", 120, 125][0] == 0 and genes["intron", 81, 119][0] == 0
    groups = {g["key"]: g["rows"] for g in page["candidate_groups"]}
    assert set(groups) == {"all", "gene_models", "promoters", "extra_tracks", "kinases"} and {r["feature_type"] for r in groups["kinases"]} == {"gene", "exon"} and groups["promoters"] == []
    assert [(b["start"], b["end"], b["target"]) for b in page["bins"]] == [(1, 300, 2)]
    sites = rows_of(tmp_path / "i" / "ctgA_1_300.sites.tsv")
    assert [(r["pos"], r["nearest_gene_name"], r["overlapping_gene_names"], r["F1_state"]) for r in sites] == [("40", "wx1", "wx1", "het"), ("130", "wx1", "wx1", "het"), ("260", "wx1", "NA", "het")]
    assert {os.path.basename(p) for p in map(str, (tmp_path / "i").iterdir())} >= {"index.html", "scan.html", "ctgA_301_700.html"}
    again = ["interactive", "--sites-tsv", str(tmp_path / "i" / "ctgA_1_300.sites.tsv"), "--samples", "B1", "F1", "F2", "--focus", "ctgA:100-300", "--outdir", str(tmp_path / "j")]
    assert main(again, spark) == 0 and json.loads((tmp_path / "j" / "ctgA_100_300.json").read_text())["patterns"] == {"target_private": 2}
    assert main(["interactive", "--outdir", str(tmp_path / "k")], spark) == 2 and main(["interactive", "--focus", "ctgA:1-2", "--outdir", str(tmp_path / "k")], spark) == 2
    assert main([*args, "--focus", "ctgA:x"], spark) == 1 and main([*args, "--focus", "ctgA:1-300", "--samples", "no", "F1", "F2"], spark) == 1


def test_private_positions_command(spark, folder, tmp_path):
    from xml.etree import ElementTree

    from cladespark.cli import main

    out = str(tmp_path / "p")
    assert main(["private-positions", "--vcf", str(folder / "small.vcf"), "--targets", "F1", "F2", "--out-prefix", out, "--chrom", "ctgA", "--end", "300"], spark) == 0
    got = {r["metric"]: r["value"] for r in rows_of(out + ".summary.tsv")}
    # homozygous targets: F2 at 40, F1 at 75; at 130, 210 and 260 the targets are heterozygous
    assert [got[k] for k in ("total_sites", "sites_in_window", "sites_skipped_no_hom_target", "qualifying_sites", "qualifying_intervals", "level_3_target_partial", "class_snp", "n_nontargets")] == ["9", "5", "3", "2", "2", "2", "2", "3"]
    rows = rows_of(out + ".intervals.tsv")
    assert [(r["interval_id"], r["chrom"], r["start"], r["end"], r["target_alleles"], r["strictness"]) for r in rows] == [("INT000001", "ctgA", "40", "40", "G", "target_partial"), ("INT000002", "ctgA", "75", "75", "T", "target_partial")]
    # assemblies: reference ACGTACGTAC; F1 and F2 differ from it at 3, F1 at 4 by its second read, F2 lacks 6, B1 covers all and differs at 8
    (tmp_path / "r.fa").write_text(">c one\nACGTA\nCGTAC\n>d\nTTTT\n")
    line = lambda pos, cigar, seq, flag=0, at="c": f"q\t{flag}\t{at}\t{pos}\t0\t{cigar}\t*\t0\t0\t{seq}\t*\n"
    (tmp_path / "F1.sam").write_text("@HD\tVN:1.6\n" + line(1, "10M", "ACTTACGTAC") + line(2, "4M", "CGGA") + line(1, "10M", "TTTTTTTTTT", 256))
    (tmp_path / "F2.sam").write_text(line(1, "5M1D2M1I2M", "ACTTAGTGAC"))
    (tmp_path / "B1.sam").write_text(line(1, "10M", "ACGTACGAAN"))
    (tmp_path / "a.tsv").write_text("# path, sample\n" + "".join(f"{tmp_path}/{s}.sam\t{s}\n" for s in ("F1", "F2", "B1")))
    assert main(["private-positions", "--assemblies", str(tmp_path / "a.tsv"), "--ref", str(tmp_path / "r.fa"), "--targets", "F1", "F2", "--out-prefix", out + "2"], spark) == 0
    rows = {(r["start"], r["end"]): (r["target_alleles"], r["nontarget_alleles"], r["strictness"], r["classification"]) for r in rows_of(out + "2.intervals.tsv")}
    assert rows == {("3", "3"): ("T", "G", "strict", "snp"), ("8", "8"): ("T", "A", "strict", "snp")}
    got = {r["metric"]: r["value"] for r in rows_of(out + "2.summary.tsv")}
    assert [got[k] for k in ("total_sites", "sites_skipped_targets_disagree", "sites_skipped_all_nontarget_carry", "qualifying_sites")] == ["4", "2", "0", "2"]
    assert main(["private-positions", "--targets", "F1", "--out-prefix", out], spark) == 2 and main(["private-positions", "--vcf", str(folder / "small.vcf"), "--targets", "nobody", "--out-prefix", out], spark) == 1
    runs.pangenome_tables(*runs.vcf_matrix(vcf.read_vcf(spark, str(folder / "small.vcf")), vcf.header(spark, str(folder / "small.vcf"))[0]), {"full": ("F1", "F2", "B1"), "target": ("F1", "F2"), "off_target": ("B1",)}, str(tmp_path / "pan"), trials=4)
    assert main(["plot", "--pangenome", str(tmp_path / "pan"), "--outdir", str(tmp_path / "fig")], spark) == 0
    for name in ("growth", "coverage", "composition"):
        assert ElementTree.parse(tmp_path / "fig" / f"{name}.svg").getroot().tag.endswith("svg")


def test_compare_diagnostics(spark):
    ddl = "locus_id string, contig string, start long, end long, strictness_class string, final_score double, ord long"
    a = spark.createDataFrame([("A1", "s#1#x", 10, 20, "strict_complete", 1.0, 0), ("A2", "y", 10, 20, "strict_complete", 1.0, 1), ("A3", "x", 100, 101, "strict_complete", 1.0, 2)], ddl)
    b = spark.createDataFrame([("B1", "x", 12, 22, "strict_complete", 1.0, 0), ("B2", "z", 1, 2, "strict_complete", 1.0, 1)], ddl)
    rules = cmp.CompareRules()
    got = cmp.diagnostics(a, b, cmp.compare(a, b, rules), rules)
    assert (got["raw_contigs_a"], got["raw_shared_contigs"], got["canonical_contigs_a"], got["canonical_shared_contigs"], got["raw_only_contigs_a_sample"], got["canonical_only_contigs_b_sample"]) == (3, 1, 2, 1, ["s#1#x", "y"], ["z"])
    assert (got["rows_a_with_candidate_contig"], got["rows_a_without_candidate_contig"], got["candidate_pairs_checked"], got["overlapping_candidate_pairs"], got["overlap_matches"], got["breakpoint_fallback_matches"], got["matched_pairs"]) == (2, 1, 2, 1, 1, 1, 2)


def test_stream_equals_batch(spark, folder):
    from cladespark.streaming.alleles import append_hits, classified

    path = str(folder / "small.vcf")
    samples, _ = vcf.header(spark, path)
    batch = vcf.read_vcf(spark, path)
    batch.repartition(3).write.parquet(str(folder / "stream_in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(folder / "stream_in"))
    append_hits(classified(stream, samples, COHORT), str(folder / "stream_out"), str(folder / "stream_state")).awaitTermination()
    got = sorted((r["pos"], r["alt"], r["final_score"]) for r in spark.read.parquet(str(folder / "stream_out")).collect())
    assert got == sorted((r["pos"], r["alt"], r["final_score"]) for r in scan.vcf_alleles(batch, samples, COHORT).filter("pattern_pass").collect()) and len(got) == 7
