"""Queries over files: the driver's tables written out as VCF, GFA, GFF3, SAM, XMFA and TSV and read back by the engine's readers.

Each text is one file, as such files are, written to the shared folder. Expressions that make a
text's fields are the same in Spark and in the oracles, so they stand once, as SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark import scan
from cladespark.operators import focus, landscape, pangenome, plot_data, private_sites
from cladespark.operators.ordering import delete_at_exit, shared_folder, stored
from cladespark.plans.catalogue import RULES, _scored_from, query
from cladespark.plans.driver_tables import COHORT, GROUPS, SQL, events, items, table
from cladespark.sinks import write_lines, write_tsv
from cladespark.sources import gfa, gff, sam, tables, vcf, xmfa

SAMPLES = GROUPS["full"]


def _place(spark: SparkSession, name: str) -> str:
    root = f"{shared_folder(spark)}/cladespark-{uuid.uuid4().hex}"
    delete_at_exit(spark, root)
    return f"{root}/{name}"


def _written(df: DataFrame, name: str, header: list[str], *order: str) -> str:
    path = _place(df.sparkSession, name)
    write_lines(df.orderBy(*order).select("line"), path, header)
    return path


def _sql(**ctes: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes.items()) + "\n"


# -- VCF ---------------------------------------------------------------------------

#: Fields of a record from a part (k is its key), in SQL that both engines read.
_REF = "CASE WHEN k % 7 = 0 THEN repeat('A', CAST(2 + k % 30 AS INTEGER)) ELSE substr('ACGT', CAST(k % 4 + 1 AS INTEGER), 1) END"
_ALT = "CASE WHEN k % 11 = 0 THEN '.' WHEN k % 5 = 0 THEN 'TT,G' WHEN k % 13 = 0 THEN '<DEL>' ELSE substr('CGTA', CAST(k % 4 + 1 AS INTEGER), 1) END"
_QUAL = "CASE WHEN k % 10 = 0 THEN '.' ELSE CAST(size AS VARCHAR(9)) END"
_FILT = "CASE k % 9 WHEN 0 THEN 'q10' WHEN 1 THEN '.' WHEN 2 THEN 'q10;PASS' ELSE 'PASS' END"
#: A cell's genotype from whether it has returned (r) and accepted (a) line items.
_GT = "CASE WHEN r IS NULL THEN './.' WHEN r + a = 0 THEN '0/0' WHEN r + a = 1 THEN '0|1' WHEN k % 5 = 0 THEN '1/2' ELSE '1/1' END"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """(k, contig, size, c0..c4): a part and its cells of the five samples."""
    cells = items(spark, sf).groupBy(F.col("locus_key").alias("k")).pivot("sample", list(SAMPLES)).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.max((F.col("l_returnflag") == "A").cast("int")).alias("a"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("contig"), F.col("p_size").alias("size")).join(cells, "k", "left")


def vcf_file(spark: SparkSession, sf: str) -> str:
    gts = [F.expr(_GT.replace("r IS", f"`{s}_r` IS").replace("r + a", f"`{s}_r` + `{s}_a`")) for s in SAMPLES]
    rows = _records(spark, sf)
    line = F.concat_ws("\t", "contig", F.col("k") * 40 + 1, F.lit("."), F.expr(_REF), F.expr(_ALT), F.expr(_QUAL), F.expr(_FILT), F.lit("DP=3"), F.lit("GT:DP"), *[F.concat(g, F.lit(":3")) for g in gts])
    contigs = [r[0] for r in rows.select("contig").distinct().orderBy("contig").collect()]
    head = ["##fileformat=VCFv4.2", *[f"##contig=<ID={c},length=1>" for c in contigs], "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *SAMPLES])]
    return _written(rows.select(line.alias("line"), "contig", "k"), "driver.vcf", head, "contig", "k")


_PICK = ", ".join(f"max(CASE WHEN sample = '{s}' THEN {c} END) AS {c}{s}" for s in SAMPLES for c in "ra")
_GTS = {s: _GT.replace("r IS", f"r{s} IS").replace("r + a", f"r{s} + a{s}") for s in SAMPLES}
_VREC = {
    "items": SQL["items"].removeprefix("items AS (")[:-1],
    "cells": "SELECT locus_key, sample, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a FROM items GROUP BY ALL",
    "wide": f"SELECT locus_key, {_PICK} FROM cells GROUP BY locus_key",
    "parts": "SELECT p_partkey AS k, p_brand AS contig, p_size AS size FROM part",
    "vrec": f"SELECT k, contig, k * 40 + 1 AS pos, {_REF} AS ref, nullif({_ALT}, '.') AS alt, TRY_CAST({_QUAL} AS DOUBLE) AS qual, {_FILT} AS filt, " + ", ".join(f"replace({g}, '|', '/') AS g{s}" for s, g in _GTS.items()) + " FROM parts LEFT JOIN wide ON locus_key = k",
    "passed": "SELECT * FROM vrec WHERE filt <> 'q10'",
}


def _over_vcf(sql: str, **more: str):
    return query(None, _sql(**_VREC, **more) + sql)


@_over_vcf("""SELECT contig, CAST(pos AS BIGINT) AS pos, CAST(pos - 1 AS BIGINT) AS start, CAST(pos - 1 + length(ref) AS BIGINT) AS "end", ref, alt, qual, CASE WHEN filt = '.' THEN '' ELSE filt END AS filters, g0 || ' ' || g1 || ' ' || g2 || ' ' || g3 || ' ' || g4 AS gts FROM vrec""")
def vcf_records(spark, sf):
    rows = vcf.read_vcf(spark, vcf_file(spark, sf))
    return rows.select("contig", "pos", "start", "end", "ref", F.array_join("alts", ",").alias("alt"), "qual", F.array_join("filters", ";").alias("filters"), F.array_join(F.transform("gts", vcf.genotype_text), " ").alias("gts"))


@_over_vcf("SELECT 'contig' AS kind, contig AS name, CAST(row_number() OVER (ORDER BY contig) - 1 AS BIGINT) AS n FROM (SELECT DISTINCT contig FROM parts) UNION ALL SELECT 'sample', s, n FROM (VALUES ('0', 0), ('1', 1), ('2', 2), ('3', 3), ('4', 4)) v(s, n)")
def vcf_header(spark, sf):
    samples, contigs = vcf.header(spark, vcf_file(spark, sf))
    return spark.createDataFrame([("sample", s, n) for n, s in enumerate(samples)] + [("contig", c, n) for n, c in enumerate(contigs)], "kind string, name string, n long")


@_over_vcf("SELECT contig, CAST(pos AS BIGINT) AS pos FROM vrec WHERE contig = 'Brand#13' AND pos - 1 < 40000 AND pos - 1 + length(ref) > 20000")
def vcf_region(spark, sf):
    return vcf.read_vcf(spark, vcf_file(spark, sf), "Brand#13:20,001-40,000").select("contig", "pos")


_ALTS = "SELECT vrec.*, string_split(alt, ',') AS alts FROM vrec"
_SHORT = "CASE WHEN length({0}) > 20 THEN substr({0}, 1, 20) || '...' ELSE {0} END"


@_over_vcf(
    f"""SELECT k, a AS alt, CASE WHEN a LIKE '<%' THEN 'sv' WHEN length(ref) = 1 AND length(a) = 1 THEN 'snp' ELSE 'indel' END AS variant_type,
  CASE WHEN list_contains(alts, '<DEL>') THEN 'sv' WHEN length(ref) = 1 AND alt <> 'TT,G' THEN 'snp' ELSE 'indel' END AS record_type,
  CASE WHEN list_contains(alts, '<DEL>') OR length(ref) >= 50 THEN 'SV-like' WHEN length(ref) = 1 AND alt <> 'TT,G' THEN 'SNP' WHEN NOT (length(ref) = 2 AND alt = 'TT') THEN 'INDEL' ELSE 'complex' END AS display_type,
  contig || ':' || pos || ':' || {_SHORT.format('ref')} || ':' || {_SHORT.format('a')} AS allele_key
  FROM (SELECT *, unnest(alts) AS a FROM valts WHERE alt IS NOT NULL)""",
    valts=_ALTS,
)
def vcf_types(spark, sf):
    """Types of alleles and records, and allele keys."""
    rows = vcf.read_vcf(spark, vcf_file(spark, sf)).filter("alts is not null")
    rows = rows.withColumns({"record_type": vcf.record_type(F.col("ref"), F.col("alts")), "display_type": vcf.display_type(F.col("ref"), F.col("alts"))}).withColumn("alt", F.explode("alts"))
    return rows.select(((F.col("pos") - 1) / 40).cast("long").alias("k"), "alt", vcf.variant_type(F.col("ref"), F.col("alt")).alias("variant_type"), "record_type", "display_type", vcf.allele_key(F.col("contig"), F.col("pos"), F.col("ref"), F.col("alt")).alias("allele_key"))


_LONG = " UNION ALL ".join(f"SELECT k, '{s}' AS sample, g{s} AS g FROM vrec" for s in SAMPLES)


@_over_vcf("SELECT k, sample, g AS genotype, CASE g WHEN './.' THEN 'no_call' WHEN '0/0' THEN 'hom_ref' WHEN '0/1' THEN 'het' WHEN '1/1' THEN 'hom_alt' ELSE 'alt_mixed' END AS state FROM vlong", vlong=_LONG)
def vcf_genotypes(spark, sf):
    rows = vcf.read_vcf(spark, vcf_file(spark, sf)).select(((F.col("pos") - 1) / 40).cast("long").alias("k"), F.inline(F.arrays_zip(F.array(*[F.lit(s) for s in SAMPLES]).alias("sample"), F.col("gts").alias("gt"))))
    return rows.select("k", "sample", vcf.genotype_text(F.col("gt")).alias("genotype"), vcf.genotype_state(F.col("gt")).alias("state"))


_CASCADE = """SELECT k, CASE WHEN alt IS NULL THEN 'no_alt' WHEN filt = 'q10' THEN 'filter' WHEN qual IS NULL OR qual < 10 THEN 'qual' WHEN alt = 'TT,G' THEN 'multiallelic' WHEN length(ref) > 1 OR alt = '<DEL>' THEN 'variant_type'
  WHEN lost / 5 > 0.6 THEN 'site_missing_rate' WHEN carriers = 0 THEN 'no_active_alt' WHEN carriers < 2 THEN 'min_alt_carriers' WHEN carriers / 5 < 0.3 THEN 'min_alt_carrier_freq' WHEN carriers / 5 > 0.6 THEN 'max_alt_carrier_freq' END AS reason
  FROM (SELECT vrec.*, s.lost, s.carriers FROM vrec JOIN (SELECT k, count(*) FILTER (WHERE g = './.') AS lost, count(*) FILTER (WHERE g NOT IN ('./.', '0/0')) AS carriers FROM vlong GROUP BY k) s USING (k))"""
_COUNTERS = " UNION ALL ".join(["SELECT 'records_seen' AS metric, CAST(count(*) AS VARCHAR) AS value FROM reasons", "SELECT 'records_kept', CAST(count(*) FILTER (WHERE reason IS NULL) AS VARCHAR) FROM reasons", "SELECT 'kept_fraction', printf('%.6f', count(*) FILTER (WHERE reason IS NULL) / count(*)) FROM reasons", *[f"SELECT 'skipped_{r}', CAST(count(*) FILTER (WHERE reason = '{r}') AS VARCHAR) FROM reasons" for r in landscape.VARIANT_REASONS]])


@_over_vcf(_COUNTERS, vlong=_LONG, reasons=_CASCADE)
def landscape_filters(spark, sf):
    """Every filter of a landscape and its counters."""
    rows = landscape.checked_runs(vcf.read_vcf(spark, vcf_file(spark, sf)))
    marked = landscape.filter_reason(rows, True, 10.0, ("snp",), True, 0.6, True, 2, 0.3, 0.6)
    return landscape.filter_summary(marked).select("metric", "value")


#: Alleles of the records that pass FILTER, with the six counts, graded and scored like the catalogue's loci.
_ALLELES = {
    "vlong": _LONG,
    "alleles": "SELECT k, contig, pos, ref, qual, i, alts[i] AS alt FROM (SELECT *, unnest(range(1, len(alts) + 1)) AS i FROM (SELECT *, string_split(alt, ',') AS alts FROM passed WHERE alt IS NOT NULL))",
    "counts": """SELECT a.k * 10 + a.i AS locus_key, CAST(count(*) FILTER (WHERE t AND has) AS BIGINT) AS target_support_n, CAST(2 AS BIGINT) AS target_total_n, CAST(count(*) FILTER (WHERE NOT t AND has) AS BIGINT) AS offtarget_support_n, CAST(3 AS BIGINT) AS offtarget_total_n,
      CAST(count(*) FILTER (WHERE t AND g = './.') AS BIGINT) AS target_missing_n, CAST(count(*) FILTER (WHERE NOT t AND g = './.') AS BIGINT) AS offtarget_missing_n
      FROM alleles a JOIN (SELECT *, sample IN ('0', '1') AS t FROM vlong) v USING (k), LATERAL (SELECT contains(g, CAST(a.i AS VARCHAR)) AS has) GROUP BY a.k, a.i""",
    "loci": """SELECT k * 10 + i AS locus_key, contig, pos - 1 AS start, pos - 1 + length(ref) AS "end", CASE WHEN alt LIKE '<%' THEN 'sv' WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snp' ELSE 'indel' END AS variant_type, qual, row_number() OVER (ORDER BY contig, pos, i) AS ord FROM alleles""",
    **_scored_from("counts", "loci"),
    "vhits": "SELECT *, row_number() OVER (ORDER BY ord) AS id, 'PPX' || lpad(CAST(row_number() OVER (ORDER BY ord) AS VARCHAR), 8, '0') AS locus_id FROM scored WHERE pattern_pass",
}


def _over_alleles(sql: str, **more: str):
    return query(None, _sql(**_VREC, **_ALLELES, **more) + sql)


def _alleles(spark, sf) -> DataFrame:
    path = vcf_file(spark, sf)
    samples, _ = vcf.header(spark, path)
    return scan.vcf_alleles(vcf.read_vcf(spark, path), samples, COHORT, RULES)


def _vcf_hits(spark, sf) -> tuple[DataFrame, list[str]]:
    path = vcf_file(spark, sf)
    samples, contigs = vcf.header(spark, path)
    return stored(scan.scan_vcf(vcf.read_vcf(spark, path), samples, contigs, COHORT, rules=RULES), "vcf_hits"), samples


@_over_alleles("SELECT locus_key, target_support_n, offtarget_support_n, target_missing_n, offtarget_missing_n, strictness_class, pattern_pass, discovery_score, penalty_score, final_score FROM scored")
def vcf_alleles(spark, sf):
    """Alleles of a VCF: exploded, counted, classified, scored."""
    key = (((F.col("pos") - 1) / 40).cast("long") * 10 + F.col("alt_i") + 1).alias("locus_key")
    return _alleles(spark, sf).select(key, "target_support_n", "offtarget_support_n", "target_missing_n", "offtarget_missing_n", "strictness_class", "pattern_pass", "discovery_score", "penalty_score", "final_score")


_PT, _PO = "target_support_n / (2 - target_missing_n)", "offtarget_support_n / (3 - offtarget_missing_n)"


@_over_alleles(
    f"""SELECT locus_key, CASE WHEN p_o > 0 THEN 'off-target support ' || printf('%.4f', p_o) || ' > threshold 0.0' WHEN p_t IS NULL THEN 'all target samples are missing/uninformative' WHEN p_t < 1 THEN 'target support ' || printf('%.4f', p_t) || ' < threshold 1.0'
  WHEN target_missing_n + offtarget_missing_n = 0 THEN 'all targets support; all off-targets confidently absent; no missing data' WHEN target_missing_n / 2 > 0.4 THEN 'target missingness ' || printf('%.4f', target_missing_n / 2) || ' > relaxed threshold 0.4'
  WHEN offtarget_missing_n / 3 > 0.4 THEN 'off-target missingness ' || printf('%.4f', offtarget_missing_n / 3) || ' > relaxed threshold 0.4' ELSE 'passes with missingness: target_missing=' || target_missing_n || ', offtarget_missing=' || offtarget_missing_n END AS pattern_reason
  FROM (SELECT *, CASE WHEN target_missing_n < 2 THEN {_PT} END AS p_t, CASE WHEN offtarget_missing_n < 3 THEN {_PO} END AS p_o FROM counts)"""
)
def allele_pattern(spark, sf):
    """Why each allele passes or not, in words."""
    return _alleles(spark, sf).select((((F.col("pos") - 1) / 40).cast("long") * 10 + F.col("alt_i") + 1).alias("locus_key"), "pattern_reason")


@_over_alleles('SELECT locus_id, contig, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", variant_type, final_score, CAST(row_number() OVER (ORDER BY final_score DESC, id) AS BIGINT) AS rank FROM vhits')
def vcf_scan(spark, sf):
    """Hits of a VCF with their ids and ranks."""
    return _vcf_hits(spark, sf)[0].select("locus_id", "contig", "start", "end", "variant_type", "final_score", "rank")


@_over_alleles("SELECT locus_id, sample AS sample_id, CASE WHEN sample IN ('0', '1') THEN 'target' ELSE 'off_target' END AS cohort_role, g AS genotype, g NOT IN ('./.', '0/0') AS allele_supported, CASE WHEN g = './.' THEN 'uninformative' WHEN g <> '0/0' THEN CASE WHEN sample IN ('0', '1') THEN 'support' ELSE 'contradiction' END WHEN sample IN ('0', '1') THEN 'ambiguous' ELSE 'absence' END AS evidence_class FROM vhits JOIN vlong ON k = locus_key // 10")
def sample_support(spark, sf):
    """Every hit with every cohort sample: samples come from the record's own array."""
    hits, samples = _vcf_hits(spark, sf)
    return scan.sample_support(hits, samples, COHORT).select("locus_id", "sample_id", "cohort_role", "genotype", "allele_supported", "evidence_class")


_QC = """SELECT 'records_evaluated' AS metric, CAST(count(*) AS BIGINT) AS value FROM vrec UNION ALL SELECT 'records_skipped_filter', count(*) FROM vrec WHERE filt = 'q10' UNION ALL SELECT 'records_skipped_qual', count(*) FROM passed WHERE qual < 5
  UNION ALL SELECT 'records_skipped_multiallelic', count(*) FROM passed WHERE (qual IS NULL OR qual >= 5) AND alt = 'TT,G' UNION ALL SELECT 'alleles_evaluated', count(*) FROM own UNION ALL SELECT 'alleles_passed', count(*) FROM own WHERE pattern_pass UNION ALL SELECT 'alleles_contradicted', count(*) FROM own WHERE strictness_class = 'contradicted'
  UNION ALL SELECT 'loci_emitted', count(*) FROM own WHERE pattern_pass UNION ALL SELECT 'regions_emitted', 0 UNION ALL SELECT 'n_target_samples', 2 UNION ALL SELECT 'n_offtarget_samples', 3 UNION ALL SELECT 'n_contigs_scanned', count(DISTINCT contig) FROM vrec UNION ALL SELECT 'strictness_' || strictness_class, count(*) FROM own GROUP BY strictness_class"""


@_over_alleles(_QC, own="SELECT scored.* FROM scored JOIN vrec ON k = locus_key // 10 WHERE (vrec.qual IS NULL OR vrec.qual >= 5) AND vrec.alt <> 'TT,G'")
def qc_counters(spark, sf):
    """All twelve metrics of a scan with a QUAL threshold and single ALTs only, and its classes."""
    path = vcf_file(spark, sf)
    samples, _ = vcf.header(spark, path)
    records, options = vcf.read_vcf(spark, path), {"min_qual": 5.0, "allow_multiallelic": False}
    counters = scan.qc(records, scan.vcf_alleles(records, samples, COHORT, RULES, **options), samples, COHORT, **options)
    return spark.createDataFrame(list(counters.items()), "metric string, value long")


@_over_alleles('SELECT locus_id, contig, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", variant_type, target_support_n, offtarget_missing_n, strictness_class, discovery_score, support_score, penalty_score, final_score FROM vhits')
def tsv_round_trip(spark, sf):
    """hits.tsv written and read back with its types."""
    path = _place(spark, "hits.tsv")
    write_tsv(_vcf_hits(spark, sf)[0].orderBy("rank"), path, tables.HITS)
    return tables.read_hits(spark, path).select("locus_id", "contig", "start", "end", "variant_type", "target_support_n", "offtarget_missing_n", "strictness_class", "discovery_score", "support_score", "penalty_score", "final_score")


@_over_vcf(
    f"SELECT feature_id, CAST(greatest(length(ref), length(a)) AS BIGINT) AS length_bp, CAST(count(sample) AS BIGINT) AS present_n FROM alts LEFT JOIN vlong ON vlong.k = alts.k AND contains(g, CAST(i AS VARCHAR)) GROUP BY alts.k, i, feature_id, ref, a",
    vlong=_LONG, alts=f"SELECT k, i, ref, alts[i] AS a, contig || ':' || pos || ':' || {_SHORT.format('ref')} || ':' || alts[i] AS feature_id FROM (SELECT *, unnest(range(1, len(alts) + 1)) AS i FROM (SELECT *, string_split(alt, ',') AS alts FROM vrec WHERE alt IS NOT NULL))",
)
def vcf_feature_matrix(spark, sf):
    """The feature matrix of a VCF: every ALT allele, without filters."""
    from cladespark.runs import vcf_matrix

    path = vcf_file(spark, sf)
    features, presence = vcf_matrix(vcf.read_vcf(spark, path), vcf.header(spark, path)[0])
    return features.join(presence, "feature_id", "left").groupBy("feature_id", "length_bp").agg(F.count("sample").alias("present_n"))


_SITES = {
    "vlong": _LONG,
    "letters": "SELECT v.k, sample, g, list_transform(string_split(g, '/'), lambda x: CASE x WHEN '0' THEN ref ELSE string_split(alt, ',')[CAST(x AS INTEGER)] END) AS l, ref FROM vlong v JOIN vrec USING (k) WHERE g <> './.' AND alt IS NOT NULL",
    "own": "SELECT k, sample, sample IN ('0', '1') AS t, list_sort(list_distinct(l)) AS s, ref FROM letters",
    "hom": "SELECT k, any_value(ref) AS ref, min(s[1]) AS target_allele, count(*) AS n_targets_observed FROM own WHERE t AND len(s) = 1 GROUP BY k HAVING count(DISTINCT s[1]) = 1",
    "sites": """SELECT h.*, o.n AS n_nontarget_observed, o.c AS n_nontarget_carries, CASE WHEN n_targets_observed = 2 THEN 1 ELSE 3 END + CASE WHEN o.c = 0 THEN 0 ELSE 1 END AS level FROM hom h JOIN (SELECT own.k, count(*) AS n, count(*) FILTER (WHERE list_contains(s, target_allele)) AS c FROM own JOIN hom USING (k) WHERE NOT t GROUP BY own.k) o USING (k) WHERE o.c < o.n""",
}
_LEVEL = "(['strict', 'nontarget_shared', 'target_partial', 'target_partial_nontarget_shared'])[level]"


@_over_vcf(f"SELECT k, target_allele, CAST(n_targets_observed AS INTEGER) AS n_targets_observed, CAST(n_nontarget_observed AS INTEGER) AS n_nontarget_observed, CAST(n_nontarget_carries AS INTEGER) AS n_nontarget_carries, {_LEVEL} AS strictness, CASE WHEN length(target_allele) <> 1 OR length(ref) <> 1 THEN 'indel' ELSE 'snp' END AS classification FROM sites", **_SITES)
def private_sites_vcf(spark, sf):
    """Sites at which all called targets agree on an allele that not every other sample has."""
    path = vcf_file(spark, sf)
    rows = vcf.read_vcf(spark, path).filter("alts is not null")
    sites = private_sites.judged(private_sites.from_vcf(rows, vcf.header(spark, path)[0], COHORT.targets), 2)
    return sites.select(((F.col("pos") - 1) / 40).cast("long").alias("k"), "target_allele", "n_targets_observed", "n_nontarget_observed", "n_nontarget_carries", "strictness", "classification")


@_over_vcf("SELECT k, CASE WHEN g0 = g3 AND g0 = g2 THEN 'all_same' WHEN g0 = g3 THEN 'target_private' WHEN g0 = g2 THEN 'background_like' ELSE 'other' END AS pattern_class, CAST(CASE WHEN contains(g3, '1') AND contains(g0, '1') AND NOT contains(g2, '1') THEN 1 ELSE 0 END + CASE WHEN contains(g3, '2') AND contains(g0, '2') AND NOT contains(g2, '2') THEN 1 ELSE 0 END AS INTEGER) AS shared FROM vrec WHERE alt IS NOT NULL AND './.' NOT IN (g0, g2, g3)")
def focus_patterns(spark, sf):
    """Pattern classes of three samples and the ALTs that two of them share against the third."""
    path = vcf_file(spark, sf)
    rows = focus.focus_sites(vcf.read_vcf(spark, path).filter("alts is not null"), list(SAMPLES), "0", "3", "2")
    return rows.select(((F.col("pos") - 1) / 40).cast("long").alias("k"), "pattern_class", F.size("shared_private_alts").alias("shared"))


@_over_vcf(
    """SELECT 'records_seen' AS metric, CAST(count(*) AS BIGINT) AS value FROM reg UNION ALL SELECT 'records_written', count(*) FROM reg WHERE reason IS NULL UNION ALL SELECT 'skipped_' || m, (SELECT count(*) FROM reg WHERE reason = m) FROM (VALUES ('biallelic'), ('filter'), ('variant_type'), ('missing')) v(m)""",
    reg="SELECT *, CASE WHEN alt IS NULL OR alt = 'TT,G' THEN 'biallelic' WHEN filt = 'q10' THEN 'filter' WHEN length(ref) > 1 OR alt = '<DEL>' THEN 'variant_type' WHEN './.' IN (g0, g2, g3) THEN 'missing' END AS reason FROM vrec WHERE contig = 'Brand#13' AND pos BETWEEN 1 AND 60000",
)
def focus_extraction(spark, sf):
    """Counters of a focus region's extraction."""
    from cladespark.focus_runs import extract_sites

    _, counters = extract_sites(vcf.read_vcf(spark, vcf_file(spark, sf)), list(SAMPLES), ("2", "0", "3"), ("Brand#13", 1, 60_000), variant_type="snp", biallelic_only=True)
    names = counters.columns
    return counters.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{c}', `{c}`" for c in names) + ") as (metric, value)"))


@_over_vcf(
    """SELECT CAST(b AS BIGINT) AS bin, CAST(1 + b * 5000 AS BIGINT) AS start, CAST(least(60000, (b + 1) * 5000) AS BIGINT) AS "end", CAST(count(*) FILTER (WHERE p = 'target_private') AS BIGINT) AS target, CAST(count(*) FILTER (WHERE p = 'background_like') AS BIGINT) AS background, CAST(count(*) FILTER (WHERE p = 'all_same') AS BIGINT) AS all_same
  FROM (SELECT unnest(range(12)) AS b) LEFT JOIN pat ON (pos - 1) // 5000 = b GROUP BY b""",
    pat="SELECT pos, CASE WHEN g0 = g3 AND g0 = g2 THEN 'all_same' WHEN g0 = g3 THEN 'target_private' WHEN g0 = g2 THEN 'background_like' ELSE 'other' END AS p FROM vrec WHERE alt IS NOT NULL AND contig = 'Brand#13' AND pos <= 60000",
)
def focus_bins(spark, sf):
    """Sites of a region by pattern class in dense bins."""
    from cladespark.operators.summaries import region_bins

    rows = vcf.read_vcf(spark, vcf_file(spark, sf)).filter("contig = 'Brand#13' and alts is not null")
    return region_bins(focus.focus_sites(rows, list(SAMPLES), "0", "3", "2", all_called=False), 1, 60_000, 5_000)


# -- GFA ---------------------------------------------------------------------------


def gfa_file(spark: SparkSession, sf: str) -> str:
    """Parts as segments (one in 17 unplaced, one in 6 by its letters), samples 0 to 3 as walks, 4 as paths."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("contig"), F.col("p_size").alias("size"))
    seq = F.when(F.col("k") % 6 == 0, F.expr("repeat('C', cast(size as int))")).otherwise("*")
    length = F.when(F.col("k") % 6 != 0, F.concat(F.lit("LN:i:"), F.col("size")))
    place = [F.when(F.col("k") % 17 != 0, F.concat(F.lit(t), c)) for t, c in (("SN:Z:", F.col("contig")), ("SO:i:", F.col("k") * 40))]
    seg = p.select(F.concat_ws("\t", F.lit("S"), F.concat(F.lit("s"), "k"), seq, length, *place).alias("line"), F.lit(1).alias("o"))
    cells = items(spark, sf).groupBy("locus_key", "sample").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r")).filter("r = 1")
    steps = cells.join(p, F.col("locus_key") == F.col("k")).groupBy("sample", "contig").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    walk = F.array_join(F.transform("ks", lambda k: F.concat(F.when(k % 2 == 0, ">").otherwise("<"), F.lit("s"), k.cast("string"))), "")
    path = F.array_join(F.transform("ks", lambda k: F.concat(F.lit("s"), k.cast("string"), F.when(k % 2 == 0, "+").otherwise("-"))), ",")
    ways = steps.select(F.when(F.col("sample") == "4", F.concat_ws("\t", F.lit("P"), F.concat_ws("#", "sample", F.lit("1"), "contig"), path, F.lit("*"))).otherwise(F.concat_ws("\t", F.lit("W"), "sample", F.lit("1"), "contig", F.lit("0"), F.lit("100"), walk)).alias("line"), F.lit(3).alias("o"))
    links = p.filter("k % 3 = 0").select(F.concat_ws("\t", F.lit("L"), F.concat(F.lit("s"), "k"), F.lit("+"), F.concat(F.lit("s"), F.col("k") + 1), F.lit("-"), F.lit("0M")).alias("line"), F.lit(2).alias("o"))
    return _written(seg.unionByName(links).unionByName(ways), "driver.gfa", ["H\tVN:Z:1.1"], "o", "line")


_GREC = {
    "items": SQL["items"].removeprefix("items AS (")[:-1],
    "calls": "SELECT locus_key, sample FROM items GROUP BY ALL HAVING bool_or(l_returnflag = 'R')",
    "seg": """SELECT p_partkey AS k, 's' || p_partkey AS name, CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS contig, CASE WHEN p_partkey % 17 <> 0 THEN p_partkey * 40 END AS start, CASE WHEN p_partkey % 17 <> 0 THEN p_partkey * 40 + p_size END AS "end", p_size AS length FROM part""",
    "steps": "SELECT name, sample, k FROM calls JOIN seg ON k = locus_key",
}


def _over_gfa(sql: str, **more: str):
    return query(None, _sql(**_GREC, **more) + sql)


@_over_gfa('SELECT name, contig, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST(length AS BIGINT) AS length FROM seg')
def gfa_segments(spark, sf):
    return gfa.read_gfa(spark, gfa_file(spark, sf))["segments"].select("name", "contig", "start", "end", "length")


@_over_gfa("SELECT sample, name AS segment, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS orient, CAST(row_number() OVER (PARTITION BY sample, p_brand ORDER BY k) - 1 AS INTEGER) AS pos FROM steps JOIN part ON p_partkey = k")
def gfa_steps(spark, sf):
    """Steps of walks and paths; names of paths give samples."""
    return gfa.read_gfa(spark, gfa_file(spark, sf))["steps"].select("sample", "segment", "orient", "pos")


@_over_gfa("SELECT 's' || p_partkey AS from_segment, '+' AS from_orient, 's' || (p_partkey + 1) AS to_segment, '-' AS to_orient, '0M' AS overlap FROM part WHERE p_partkey % 3 = 0")
def gfa_links(spark, sf):
    return gfa.read_gfa(spark, gfa_file(spark, sf))["links"]


@_over_gfa("SELECT DISTINCT sample FROM steps")
def gfa_samples(spark, sf):
    return spark.createDataFrame([(s,) for s in gfa.samples(gfa.read_gfa(spark, gfa_file(spark, sf)))], "sample string")


_COVER = {
    "m": """SELECT sample, contig, start, "end", max("end") OVER (PARTITION BY sample, contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM steps JOIN seg USING (name) WHERE contig IS NOT NULL AND "end" > start""",
    "i": """SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY sample, contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS n FROM m""",
    "cover": 'SELECT sample, contig, min(start) AS start, max("end") AS "end" FROM i GROUP BY sample, contig, n',
}


def _index(spark, sf) -> dict:
    """The graph's index, written and read back with its fingerprint checked."""
    path = gfa_file(spark, sf)
    at = gfa.default_index(path)
    gfa.write_index(gfa.scan_index(gfa.read_gfa(spark, path, length_from_tag=True)), at, path)
    return gfa.index_for(spark, path)


@_over_gfa('SELECT sample, contig, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM cover', **_COVER)
def gfa_coverage(spark, sf):
    """Merged intervals that each sample's segments cover, from the stored index."""
    return _index(spark, sf)["coverage"].select("sample", "contig", "start", "end")


_GRAPH = {
    **_COVER,
    "wanted": """SELECT * FROM seg WHERE contig IS NOT NULL AND "end" - start >= 2 AND name IN (SELECT name FROM steps WHERE sample IN ('0', '1'))""",
    "called": """SELECT name, sample, max(w) AS w FROM (SELECT w.name, c.sample, 0 AS w FROM wanted w JOIN cover c ON c.contig = w.contig AND c.start < w."end" AND w.start < c."end" UNION ALL SELECT name, sample, 1 FROM steps WHERE name IN (SELECT name FROM wanted)) GROUP BY name, sample""",
    "counts": """SELECT k AS locus_key, CAST(count(*) FILTER (WHERE w = 1 AND sample IN ('0', '1')) AS BIGINT) AS target_support_n, CAST(2 AS BIGINT) AS target_total_n, CAST(count(*) FILTER (WHERE w = 1 AND sample NOT IN ('0', '1')) AS BIGINT) AS offtarget_support_n, CAST(3 AS BIGINT) AS offtarget_total_n,
      CAST(2 - count(*) FILTER (WHERE sample IN ('0', '1')) AS BIGINT) AS target_missing_n, CAST(3 - count(*) FILTER (WHERE sample NOT IN ('0', '1')) AS BIGINT) AS offtarget_missing_n FROM called JOIN seg USING (name) GROUP BY k""",
    "loci": """SELECT k AS locus_key, contig, start, "end", 'graph_region' AS variant_type, CAST(NULL AS DOUBLE) AS qual, row_number() OVER (ORDER BY contig, start, "end", name) AS ord FROM wanted""",
    **_scored_from("counts", "loci"),
}


@_over_gfa(
    """SELECT locus_key, target_support_n, offtarget_support_n, target_missing_n, offtarget_missing_n, strictness_class, pattern_pass, final_score,
  CASE WHEN "end" - start < 50 THEN 'small_indel_like' ELSE 'sv_like' END AS segment_length_class, contig || ':' || (start + 1) || ':SEG:s' || locus_key AS allele_key FROM scored""",
    **_GRAPH,
)
def gfa_scan(spark, sf):
    """Segments that targets traverse: counted with coverage, classified, scored."""
    rows = scan.scan_gfa(_index(spark, sf), COHORT, RULES, min_length=2)
    return rows.select(F.substring("name", 2, 20).cast("long").alias("locus_key"), "target_support_n", "offtarget_support_n", "target_missing_n", "offtarget_missing_n", "strictness_class", "pattern_pass", "final_score", "segment_length_class", "allele_key")


@_over_gfa(
    """SELECT 'GPX' || lpad(CAST(row_number() OVER (ORDER BY ord) AS VARCHAR), 8, '0') AS locus_id, 's' || locus_key AS name, CAST(row_number() OVER (ORDER BY final_score DESC, ord) AS BIGINT) AS rank,
  CASE WHEN offtarget_missing_n = 3 THEN 'unseen' WHEN offtarget_missing_n = 0 AND offtarget_support_n = 0 THEN 'clear' ELSE 'mixed' END AS meaning FROM scored WHERE pattern_pass""",
    **_GRAPH,
)
def gfa_hits(spark, sf):
    """Ids, ranks and what each private segment means."""
    rows = scan.gfa_hits(scan.scan_gfa(_index(spark, sf), COHORT, RULES, min_length=2)).withColumn("t", scan.graph_interpretation())
    meaning = F.when(F.contains("t", F.lit("private-node")), "unseen").when(F.contains("t", F.lit("do not traverse")), "clear").otherwise("mixed")
    return rows.select("locus_id", "name", "rank", meaning.alias("meaning"))


@_over_gfa("SELECT name AS feature_id, CAST(length AS BIGINT) AS length_bp, CAST(count(sample) AS BIGINT) AS present_n FROM seg LEFT JOIN (SELECT DISTINCT name AS n, sample FROM steps) ON n = name GROUP BY name, length")
def gfa_feature_matrix(spark, sf):
    from cladespark.runs import gfa_matrix

    features, presence = gfa_matrix(gfa.read_gfa(spark, gfa_file(spark, sf)))
    return features.join(presence, "feature_id", "left").groupBy("feature_id", "length_bp").agg(F.count("sample").alias("present_n"))


@_over_gfa("""SELECT 'segment' AS kind, name FROM seg WHERE contig = 'Brand#13' AND start < 30000 AND "end" > 10000 UNION ALL SELECT 'traversing', sample FROM steps WHERE k IN (6, 7, 8, 9) GROUP BY sample UNION ALL SELECT 'present', sample FROM (SELECT sample FROM cover WHERE contig = 'Brand#13' AND start < 30000 AND "end" > 10000 UNION SELECT sample FROM steps JOIN part ON p_partkey = k WHERE sample <> '4' AND p_brand = 'Brand#13' AND 100 > 10000) GROUP BY sample""", **_COVER)
def graph_queries(spark, sf):
    """Segments at a place, samples traversing segments, samples present at a place."""
    path = gfa_file(spark, sf)
    graph = gfa.read_gfa(spark, path)
    index = gfa.scan_index(graph)
    kind = lambda df, k, c: df.select(F.lit(k).alias("kind"), F.col(c).alias("name"))
    who = gfa.traversing(index, ["s6", "s7", "s8", "s9"]).select("sample").distinct()
    return kind(gfa.segments_at(index, "Brand#13", 10_000, 30_000), "segment", "name").unionByName(kind(who, "traversing", "sample")).unionByName(kind(gfa.present_at(graph, index, "Brand#13", 10_000, 30_000), "present", "sample"))


# -- GFF3 --------------------------------------------------------------------------


def gff_file(spark: SparkSession, sf: str) -> str:
    """Events of side 1 as genes, a transcript each, and parts by their number."""
    e = events(spark, sf).filter("side = 1")
    line = lambda kind, a, b, attrs: F.concat_ws("\t", F.concat(F.lit("chr_"), "contig"), F.lit("x"), F.lit(kind), a + 1, b, F.lit("."), F.when(F.col("ord") % 2 == 0, "+").otherwise("-"), F.lit("."), attrs)
    gene = line("gene", F.col("start"), F.col("end") + 300, F.concat(F.lit("ID="), "locus_id", F.when(F.col("ord") % 4 != 0, F.concat(F.lit(";Name=the%20"), "locus_id")).otherwise("")))
    kinds = F.when(F.col("ord") % 3 == 0, "CDS").when(F.col("ord") % 3 == 1, "three_prime_UTR").otherwise("exon")
    part = F.concat_ws("\t", F.concat(F.lit("chr_"), "contig"), F.lit("x"), kinds, F.col("start") + 1, F.col("end"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("Parent="), "locus_id"))
    rows = e.select(F.explode(F.array(gene, part)).alias("line"), "ord")
    return _written(rows, "driver.gff3", ["##gff-version 3", "short\trow"], "ord", "line")


_EV = SQL["ev"].removeprefix("ev AS (")[:-1]


@query(None, _sql(ev=_EV) + """SELECT 'chr_' || contig AS contig, 'gene' AS type, CAST(start AS BIGINT) AS start, CAST("end" + 300 AS BIGINT) AS "end", CASE WHEN ord % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN ord % 4 <> 0 THEN 'the ' ELSE '' END || locus_id AS gene_id, locus_id AS id FROM ev WHERE side = 1
  UNION ALL SELECT 'chr_' || contig, CASE ord % 3 WHEN 0 THEN 'CDS' WHEN 1 THEN 'three_prime_UTR' ELSE 'exon' END, CAST(start AS BIGINT), CAST("end" AS BIGINT), '+', '', NULL FROM ev WHERE side = 1""")
def gff_features(spark, sf):
    """Features with decoded attributes."""
    rows = gff.read_gff(spark, gff_file(spark, sf), decode=True)
    return rows.select("contig", "type", "start", "end", "strand", "gene_id", F.try_element_at("attrs", F.lit("ID")).alias("id"))


def alias_file(spark: SparkSession, sf: str) -> str:
    rows = events(spark, sf).select("contig").distinct().select(F.concat_ws("\t", F.concat(F.lit("chr_"), "contig"), "contig").alias("line"))
    return _written(rows, "alias.tsv", ["# name in the features, name of the loci"], "line")


@query(None, _sql(ev=_EV) + """SELECT DISTINCT contig AS alias_from, 'chr_' || contig AS alias_to FROM ev""")
def contig_aliases(spark, sf):
    return gff.read_aliases(spark, alias_file(spark, sf))


@query(None, _sql(
    ev=_EV, q="SELECT * FROM ev WHERE side = 0", genes="""SELECT CASE WHEN ord % 4 <> 0 THEN 'the%20' ELSE '' END || locus_id AS gene_id, contig, start, "end" + 300 AS "end", ord FROM ev WHERE side = 1""",
    g="""SELECT ord, gene_id FROM (SELECT q.ord, gene_id, row_number() OVER (PARTITION BY q.ord ORDER BY g.start, g.ord) AS t FROM q JOIN genes g ON q.contig = g.contig AND q.start < g."end" AND g.start < q."end") WHERE t = 1""",
    kinds="""SELECT q.ord, max(CASE p.ord % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END) AS kind FROM q JOIN ev p ON p.side = 1 AND q.contig = p.contig AND q.start < p."end" AND p.start < q."end" GROUP BY q.ord""",
) + "SELECT locus_id, g.gene_id, CASE WHEN g.gene_id IS NULL THEN 'intergenic' WHEN kind = 3 THEN 'CDS' WHEN kind = 2 THEN 'UTR' WHEN kind = 1 THEN 'exon' ELSE 'intronic' END AS annotation_class FROM q LEFT JOIN g USING (ord) LEFT JOIN kinds USING (ord)")
def annotate_files(spark, sf):
    """Loci annotated from a GFF3 file through an alias file."""
    from cladespark.operators.annotate import annotate

    genes, parts = gff.genes_and_parts(gff.read_gff(spark, gff_file(spark, sf)))
    loci = events(spark, sf).filter("side = 0").drop("side")
    return annotate(loci, genes, parts, gff.read_aliases(spark, alias_file(spark, sf))).select("locus_id", "gene_id", "annotation_class")


#: Gene models over orders: a customer is a gene, its first orders' numbers are the places of exons, line counts their lengths.
_EXONS = "SELECT o_custkey AS g, o_orderkey * 10 AS a, o_orderkey * 10 + 15 AS b FROM orders"
_MERGED = {
    "ex": _EXONS,
    "em": "SELECT *, max(b) OVER (PARTITION BY g ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ex",
    "ei": "SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM em",
    "exons": "SELECT g, min(a) AS a, max(b) AS b FROM ei GROUP BY g, n",
    "genes": "SELECT g, min(a) AS a, max(b) AS b FROM ex GROUP BY g",
}


@query(None, _sql(**_MERGED) + """SELECT g AS gene_id, 'exon' AS part, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end" FROM exons UNION ALL SELECT g, 'intron', b + 1, n - 1 FROM (SELECT *, lead(a) OVER (PARTITION BY g ORDER BY a) AS n FROM exons) WHERE n - 1 >= b + 1
  UNION ALL SELECT g, 'gene', a, b FROM genes UNION ALL SELECT g, 'promoter', CASE WHEN g % 2 = 0 THEN greatest(1, a - 200) ELSE b + 1 END, CASE WHEN g % 2 = 0 THEN a - 1 ELSE b + 200 END FROM genes WHERE NOT (g % 2 = 0 AND a <= 1)""")
def gene_models(spark, sf):
    """Merged exons, introns between them, genes, and promoters by strand."""
    ex = table(spark, sf, "orders").select(F.col("o_custkey").alias("gene_id"), F.lit("exon").alias("type"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 15).alias("end"))
    strand = F.when(F.col("gene_id") % 2 == 0, "+").otherwise("-")
    genes = ex.groupBy("gene_id").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("type", F.lit("gene"))
    return focus.gene_models(ex.unionByName(genes).withColumn("strand", strand), 200).select("gene_id", "part", "start", "end")


@query(None, "SELECT o_custkey AS gene_id, arg_min(o_orderkey, (CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, -CAST(floor(o_totalprice) AS BIGINT), lpad(CAST(o_orderkey AS VARCHAR), 12, '0'))) AS chosen FROM orders GROUP BY o_custkey")
def chosen_transcripts(spark, sf):
    """Per gene the transcript marked longest, else the longest, else the least id."""
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("gene_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("transcript_id"), (F.col("o_orderpriority") == "1-URGENT").alias("longest"), F.lit(0).cast("long").alias("start"), F.floor("o_totalprice").cast("long").alias("end"))
    return focus.chosen_transcript(t).select("gene_id", F.col("transcript_id").cast("long").alias("chosen"))


@query(None, "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN n_name ELSE 'by id ' || s_nationkey END AS functional FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def functional_join(spark, sf):
    """Functional texts by a gene's name, else by its id."""
    n = table(spark, sf, "nation")
    by_name = n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("name"), "n_nationkey").alias("gene"), F.lit(None).cast("string").alias("gene_id"), F.col("n_name").alias("text"), F.col("n_nationkey").alias("ord"))
    by_id = n.select(F.lit(None).cast("string").alias("gene"), F.concat(F.lit("id"), "n_nationkey").alias("gene_id"), F.concat(F.lit("by id "), "n_nationkey").alias("text"), F.col("n_nationkey").alias("ord"))
    features = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("name"), "s_nationkey").alias("gene_name"), F.concat(F.lit("id"), "s_nationkey").alias("gene_id"))
    return focus.functional(features, by_name.unionByName(by_id)).select("s_suppkey", "functional")


@query(None, "SELECT p_partkey, 'steel' AS grp FROM part WHERE contains(lower(p_name || ' ' || p_type), 'steel') OR contains(lower(p_name || ' ' || p_type), 'small') UNION ALL SELECT p_partkey, 'red' FROM part WHERE contains(lower(p_name || ' ' || p_type), 'red')")
def keyword_groups(spark, sf):
    """Features whose joined texts hold any term of a group."""
    rows = focus.candidate_groups(table(spark, sf, "part"), {"steel": ("STEEL", "small"), "red": ("red",)}, ("p_name", "p_type"))
    return rows.select("p_partkey", F.col("group").alias("grp"))


# -- reads -------------------------------------------------------------------------

#: A line item is a read over its part's locus: n is its line number.
_READ = "SELECT l_partkey AS k, l_linenumber AS n, l_returnflag AS flag, CAST(c_nationkey AS VARCHAR) AS sample FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (0, 1, 2, 3, 4)"


def _read_files(spark: SparkSession, sf: str) -> list[tuple[str, str]]:
    """One SAM file per sample; read 3 has bad bases, 5 maps badly, 6 is secondary, 4 deletes the locus' base."""
    customer = table(spark, sf, "customer").filter(F.col("c_nationkey").isin(*map(int, SAMPLES))).select("c_custkey", "c_nationkey")
    own = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    n, base = F.col("l_linenumber"), F.when(F.col("l_returnflag") == "R", "T").when(F.col("l_returnflag") == "A", "G").otherwise("A")
    seq = F.when(n == 4, "CCCCCC").otherwise(F.concat(F.lit("CC"), base, F.lit("CCC")))
    line = F.concat_ws("\t", F.concat(F.lit("r"), "l_orderkey"), F.when(n == 6, 256).otherwise(0), F.lit("g"), F.col("l_partkey") * 40 - 1, F.when(n == 5, 5).otherwise(60), F.when(n == 4, "2M1D4M").otherwise("6M"), F.lit("*"), F.lit(0), F.lit(0), seq, F.when(n == 3, "!!!!!!").otherwise("IIIIII"))
    rows = stored(own.select(F.col("c_nationkey").cast("string").alias("s"), line.alias("line")), "reads")
    return [(_written(rows.filter(F.col("s") == s), f"{s}.sam", ["@HD\tVN:1.6", f"@RG\tID:1\tSM:{s}"], "line"), s) for s in SAMPLES]


def _read_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of every part and sample: parts of even keys as SNPs, the others as indels of up to 6 bases."""
    files = sam.sample_pairs(spark, [path for path, _ in _read_files(spark, sf)], None)
    blocks = None
    for path, s in files:
        own = sam.aligned_blocks(sam.read_sam(spark, path, s))
        blocks = own if blocks is None else blocks.unionByName(own)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.lit("g").alias("contig"), (F.col("p_partkey") * 40).alias("start"), F.col("p_size").alias("size"))
    loci = p.select("ord", "contig", "start", F.when(F.col("ord") % 2 == 0, F.col("start") + 1).otherwise(F.col("start") + 1 + F.col("size") % 6).alias("end"), F.lit("A").alias("ref"), F.lit("T").alias("alt"), F.when(F.col("ord") % 2 == 0, "snp").otherwise("indel").alias("variant_type"))
    return sam.read_evidence(sam.allele_counts(loci, blocks, list(SAMPLES)), COHORT.targets, min_depth=3, min_alt=1)


_PILE = {
    "rd": _READ,
    "frame": "SELECT p_partkey AS k, s AS sample, p_partkey % 2 = 0 AS snp, 1 + p_size % 6 AS len FROM part CROSS JOIN (VALUES ('0'), ('1'), ('2'), ('3'), ('4')) v(s)",
    "pile": """SELECT f.k, f.sample, f.snp, count(n) FILTER (WHERE n IN (1, 2, 7) AND flag = 'N') AS r, count(n) FILTER (WHERE n IN (1, 2, 7) AND flag = 'R') AS t, count(n) FILTER (WHERE n IN (1, 2, 4, 7)) AS d,
      coalesce(sum(CASE WHEN n IN (1, 2, 3, 7) THEN least(len, 4) WHEN n = 4 THEN least(len, 5) - 1 ELSE 0 END), 0) // any_value(len) AS mean FROM frame f LEFT JOIN rd ON rd.k = f.k AND rd.sample = f.sample GROUP BY ALL""",
    "counted": "SELECT k, sample, snp, CASE WHEN snp THEN r ELSE mean END AS ref_n, CASE WHEN snp THEN t ELSE 0 END AS alt_n, CASE WHEN snp THEN d ELSE mean END AS depth FROM pile",
    "evid": """SELECT *, CASE WHEN depth < 3 OR NOT snp THEN 'uninformative' WHEN sample IN ('0', '1') THEN CASE WHEN has THEN 'support' ELSE 'ambiguous' END WHEN has THEN 'contradiction' ELSE 'absence' END AS evidence_class FROM (SELECT *, CASE WHEN depth > 0 THEN round(alt_n / depth, 4) ELSE 0 END AS fraction, alt_n >= 1 AND depth > 0 AND round(alt_n / depth, 4) >= 0.2 AS has FROM counted)""",
}


@query(None, _sql(**_PILE) + "SELECT k, sample, CAST(ref_n AS BIGINT) AS ref_n, CAST(alt_n AS BIGINT) AS alt_n, CAST(depth AS BIGINT) AS depth, CAST(fraction AS DOUBLE) AS allele_fraction, evidence_class FROM evid")
def read_evidence(spark, sf):
    """Allele counts, depth, fraction and class of every locus and sample, from SAM files."""
    return _read_evidence(spark, sf).select(F.col("ord").alias("k"), "sample", F.col("ref_n").cast("long").alias("ref_n"), F.col("alt_n").cast("long").alias("alt_n"), F.col("depth").cast("long").alias("depth"), "allele_fraction", "evidence_class")


@query(None, _sql(**_PILE) + "SELECT k, round(least(coalesce(avg(CASE evidence_class WHEN 'support' THEN 1.0 WHEN 'ambiguous' THEN 0.3 WHEN 'contradiction' THEN -1.0 WHEN 'absence' THEN 1.0 END), 0), 1), 6) AS support FROM evid GROUP BY k")
def support_score(spark, sf):
    """The mean of each locus' informative evidence."""
    return sam.locus_support(_read_evidence(spark, sf)).select(F.col("ord").alias("k"), "support")


@query(None, _sql(**_VREC, **{"vlong": _LONG}, **_PILE) + "SELECT 'vcf' AS source_type, k, sample, CASE WHEN g = './.' THEN 'uninformative' WHEN g <> '0/0' THEN CASE WHEN sample IN ('0', '1') THEN 'support' ELSE 'contradiction' END WHEN sample IN ('0', '1') THEN 'ambiguous' ELSE 'absence' END AS evidence_class FROM vlong UNION ALL SELECT 'bam', k, sample, evidence_class FROM evid")
def evidence_union(spark, sf):
    """Genotype evidence and read evidence of all loci, one below the other."""
    path = vcf_file(spark, sf)
    rows = vcf.read_vcf(spark, path).select(((F.col("pos") - 1) / 40).cast("long").alias("k"), "gts")
    own = scan.sample_support(rows.withColumns({"locus_id": F.col("k"), "rank": F.lit(0)}), vcf.header(spark, path)[0], COHORT)
    named = own.select(F.lit("vcf").alias("source_type"), F.col("locus_id").alias("k"), F.col("sample_id").alias("sample"), "evidence_class")
    return named.unionByName(_read_evidence(spark, sf).select(F.lit("bam").alias("source_type"), F.col("ord").alias("k"), "sample", "evidence_class"))


@query(None, _sql(rd=_READ) + """SELECT s AS sample, CAST(p AS BIGINT) AS pos, CAST(count(k) AS BIGINT) AS depth FROM (VALUES ('0'), ('1'), ('2'), ('3'), ('4')) v(s) CROSS JOIN (SELECT unnest(range(4000, 12000)) AS p) LEFT JOIN rd ON rd.sample = s AND n NOT IN (5, 6) AND p BETWEEN k * 40 - 2 AND k * 40 + CASE WHEN n = 4 THEN 4 ELSE 3 END AND NOT (n = 4 AND p = k * 40) AND k BETWEEN 99 AND 301 GROUP BY s, p""")
def position_depth(spark, sf):
    """Depth of every base of a range and sample, zeros included."""
    blocks = None
    for path, s in _read_files(spark, sf):
        own = sam.aligned_blocks(sam.read_sam(spark, path, s))
        blocks = own if blocks is None else blocks.unionByName(own)
    return sam.position_depth(blocks, "g", 4_000, 12_000).select("sample", "pos", "depth")


# -- alignments ------------------------------------------------------------------------


def xmfa_file(spark: SparkSession, sf: str) -> str:
    """A block per part: the reference has ACGTA, a sample that carries has T in column 2, one that is absent a gap in column 3 for one part in five."""
    rows = _records(spark, sf)
    at = F.col("k") * 10 + 1
    ref = F.concat(F.lit(">1:"), at, F.lit("-"), at + 4, F.lit(" + ref.fa\nACGTA\n"))
    own = [F.when(F.col(f"`{s}_r`").isNotNull(), F.concat(F.lit(f">{int(s) + 2}:1-5 + s{s}.fa\nA"), F.when(F.col(f"`{s}_r`") == 1, "T").otherwise("C"), F.when((F.col(f"`{s}_r`") == 0) & (F.col("k") % 5 == 0), "-").otherwise("G"), F.lit("ta\n"))).otherwise("") for s in SAMPLES]
    return _written(rows.select(F.concat(ref, *own, F.lit("=")).alias("line"), "k"), "driver.xmfa", ["#FormatVersion Mauve1", "#Sequence1File=ref.fa"], "k")


_COLS = {
    "items": SQL["items"].removeprefix("items AS (")[:-1],
    "calls": "SELECT locus_key AS k, sample, bool_or(l_returnflag = 'R') AS c FROM items GROUP BY ALL",
    "st": "SELECT k * 10 + 1 + i AS pos, substr('ACGTA', CAST(i + 1 AS INTEGER), 1) AS ref, sample, CASE WHEN i = 1 AND c THEN 'T' WHEN i = 2 AND NOT c AND k % 5 = 0 THEN '-' ELSE substr('ACGTA', CAST(i + 1 AS INTEGER), 1) END AS state FROM calls, (SELECT unnest(range(5)) AS i)",
}


@query(None, _sql(**_COLS) + "SELECT CAST(pos AS BIGINT) AS pos, ref, 's' || sample AS sample, state FROM st UNION ALL SELECT p_partkey * 10 + 1 + i, substr('ACGTA', CAST(i + 1 AS INTEGER), 1), 'ref', substr('ACGTA', CAST(i + 1 AS INTEGER), 1) FROM part, (SELECT unnest(range(5)) AS i)")
def xmfa_states(spark, sf):
    """Columns of alignment blocks, placed on the reference."""
    return xmfa.reference_states(xmfa.read_xmfa(spark, xmfa_file(spark, sf)), "ref").select("pos", "ref", "sample", "state")


_JUDGED = {
    "tt": "SELECT pos, any_value(ref) AS ref, min(state) AS target_allele, count(*) AS n_t FROM st WHERE sample IN ('0', '1') GROUP BY pos HAVING count(DISTINCT state) = 1",
    "judged": "SELECT tt.*, o.n AS n_o, o.c, CASE WHEN n_t = 2 THEN 1 ELSE 3 END + CASE WHEN o.c = 0 THEN 0 ELSE 1 END AS level FROM tt JOIN (SELECT st.pos, count(*) AS n, count(*) FILTER (WHERE state = target_allele) AS c FROM st JOIN tt USING (pos) WHERE sample NOT IN ('0', '1') GROUP BY st.pos) o USING (pos) WHERE o.c < o.n",
    "runs": "SELECT *, pos - row_number() OVER (ORDER BY pos) AS island FROM judged",
}


def _xmfa_sites(spark, sf) -> DataFrame:
    states = xmfa.reference_states(xmfa.read_xmfa(spark, xmfa_file(spark, sf)), "ref").filter("sample <> 'ref'")
    return private_sites.judged(private_sites.from_states(states, ("s0", "s1")), 2)


@query(None, _sql(**_COLS, **_JUDGED) + f"SELECT CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) AS BIGINT) AS \"end\", CAST(count(*) AS BIGINT) AS n_sites, {_LEVEL.replace('[level]', '[max(level)]')} AS strictness, CAST(min(n_t) AS INTEGER) AS n_targets_observed, CAST(min(n_o) AS INTEGER) AS min_nontarget_observed, CAST(max(c) AS INTEGER) AS max_nontarget_carries FROM runs GROUP BY island")
def private_intervals(spark, sf):
    """Private columns of alignments as runs of consecutive positions."""
    return private_sites.intervals(_xmfa_sites(spark, sf)).select("start", "end", "n_sites", "strictness", "n_targets_observed", "min_nontarget_observed", "max_nontarget_carries")


@query(None, _sql(**_COLS, **_JUDGED, named=f"SELECT *, {_LEVEL} AS s FROM judged", isl=f"SELECT {_LEVEL.replace('[level]', '[max(level)]')} AS s, max(pos) - min(pos) + 1 AS bp, CASE WHEN bool_or(target_allele = '-') AND bool_or(target_allele <> '-') THEN 'mixed' WHEN bool_or(target_allele = '-') THEN 'indel' ELSE 'snp' END AS c FROM runs GROUP BY island") + "SELECT 'sites_' || s AS metric, CAST(count(*) AS BIGINT) AS value FROM named GROUP BY s UNION ALL SELECT 'intervals_' || s, count(*) FROM isl GROUP BY s UNION ALL SELECT 'intervals_' || c, count(*) FROM isl GROUP BY c UNION ALL SELECT 'interval_bp', sum(bp) FROM isl")
def private_summary(spark, sf):
    sites = stored(_xmfa_sites(spark, sf), "sites")
    return private_sites.summary(sites, private_sites.intervals(sites))


@query(None, _sql(**{"items": _COLS["items"], "calls": _COLS["calls"]}, sites="SELECT DISTINCT k FROM calls WHERE c") + "SELECT sites.k AS pos, s AS sample, CASE WHEN c THEN 'T' ELSE 'A' END AS state FROM sites CROSS JOIN (VALUES ('0'), ('1'), ('2'), ('3'), ('4')) v(s) LEFT JOIN calls ON calls.k = sites.k AND sample = s WHERE c OR sites.k % (CAST(s AS INTEGER) + 2) <> 0")
def assembly_states(spark, sf):
    """States of assemblies at the union of their variants; where none is, coverage says the reference."""
    cells = items(spark, sf).groupBy("locus_key", "sample").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    variants = cells.filter("r = 1").select(F.lit("c").alias("contig"), F.col("locus_key").alias("pos"), "sample", F.lit("A").alias("ref"), F.lit("T").alias("alt"))
    keys = table(spark, sf, "part").select(F.col("p_partkey").alias("start"))
    coverage = None
    for s in SAMPLES:  # every place but the multiples of sample + 2
        own = keys.filter(F.col("start") % (int(s) + 2) != 0).select(F.lit(s).alias("sample"), F.lit("c").alias("contig"), "start", F.col("start").alias("end"))
        coverage = own if coverage is None else coverage.unionByName(own)
    return private_sites.assembly_states(variants, coverage, SAMPLES).select("pos", "sample", "state")


# -- plots and dashboards ----------------------------------------------------------------


@query("sw", "SELECT contig, w, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\", " + ", ".join(f"max(CASE WHEN sample = '{s}' THEN CAST(nonref_n AS DOUBLE) END) AS \"s{s}\"" for s in SAMPLES) + ' FROM sw GROUP BY contig, w, start, "end"')
def window_heatmap(spark, sf):
    from cladespark.plans.catalogue import _windowed

    out = plot_data.heatmap(_windowed(spark, sf)[1].withColumn("v", F.col("nonref_n").cast("double")), "v", list(SAMPLES))
    return out.select("contig", "w", "start", "end", *[F.col(f"`{s}`").alias(f"s{s}") for s in SAMPLES])


@query("sw near", """, sn AS (SELECT sw.*, nearest FROM sw LEFT JOIN near USING (contig, w, sample)), tops AS (SELECT contig, w, nearest, count(*) AS k, min(sample) AS f FROM near GROUP BY ALL), best AS (SELECT contig, w, arg_min(nearest, (-k, f)) AS top, max(k) AS top_n FROM tops GROUP BY ALL),
ext AS (SELECT w.contig, w.w, sum(t) AS tp, sum(o) AS op FROM wins w JOIN (SELECT contig, i, max(CASE WHEN carry_t > 0 AND carry_o = 0 THEN 1 ELSE 0 END) AS t, max(CASE WHEN carry_o > 0 AND carry_t = 0 THEN 1 ELSE 0 END) AS o FROM marks GROUP BY ALL) m ON m.contig = w.contig AND m.i >= w.lo AND m.i < w.hi GROUP BY ALL)
SELECT sn.contig, sn.w, CAST(any_value(n_variants) AS BIGINT) AS n_variants, CAST(greatest(any_value("end" - start), 1) AS BIGINT) AS span_bp, round(any_value(n_variants) / (greatest(any_value("end" - start), 1) / 1000), 6) AS density_variants_per_kb, round(avg(CASE WHEN role = 'target' THEN round(missing_n / n_variants, 6) END), 9) AS target_mean_missing_rate,
round(avg(CASE WHEN role = 'off_target' THEN round(missing_n / n_variants, 6) END), 9) AS offtarget_mean_missing_rate, any_value(top) AS top_nearest_background, CAST(any_value(top_n) AS BIGINT) AS top_nearest_background_n, CAST(any_value(tp) AS BIGINT) AS target_private_alt_n, CAST(any_value(op) AS BIGINT) AS offtarget_private_alt_n
FROM sn JOIN best USING (contig, w) JOIN ext USING (contig, w) GROUP BY sn.contig, sn.w""")
def window_rows(spark, sf):
    """One row per window: span, density, means by role, private events, and the most frequent nearest sample."""
    from cladespark.plans.catalogue import _with_nearest

    rows = _with_nearest(spark, sf)
    near = rows.filter("nearest is not null").select("contig", "w", "sample", "nearest", F.col("sample").cast("int").alias("sample_ord"))
    out = landscape.window_rows(rows, near)
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select("contig", "w", "n_variants", F.col("span_bp").cast("long").alias("span_bp"), r("density_variants_per_kb", 6), r("target_mean_missing_rate", 9), r("offtarget_mean_missing_rate", 9), "top_nearest_background", "top_nearest_background_n", "target_private_alt_n", "offtarget_private_alt_n")


@query("sw", "SELECT 'LW' || lpad(CAST(row_number() OVER (ORDER BY contig, w) AS VARCHAR), 8, '0') AS window_id, contig, w FROM (SELECT DISTINCT contig, w FROM sw)")
def window_ids(spark, sf):
    from cladespark.plans.catalogue import _windowed

    return landscape.with_window_ids(_windowed(spark, sf)[1].select("contig", "w").distinct()).select("window_id", "contig", "w")


@query("sw", "SELECT contig, CAST(count(DISTINCT w) AS BIGINT) AS n_windows, CAST(min(start) AS BIGINT) AS start, CAST(max(\"end\") AS BIGINT) AS \"end\" FROM sw GROUP BY contig")
def plot_index(spark, sf):
    from cladespark.plans.catalogue import _windowed

    return plot_data.plot_index(_windowed(spark, sf)[1])


@query("pairs", "SELECT sample_a, sample_b, round(avg(similarity), 9) AS similarity FROM pairs GROUP BY ALL")
def mean_similarity(spark, sf):
    from cladespark.plans.driver_tables import genotypes

    return plot_data.mean_similarity(landscape.pair_similarity(genotypes(spark, sf), 20, 10)).select("sample_a", "sample_b", F.round("similarity", 9).alias("similarity"))


@query("ev", "SELECT contig, contig_prefix, contig_number, CAST(count(*) AS BIGINT) AS n FROM (SELECT contig || (ord % 12) AS contig, contig AS contig_prefix, CAST(ord % 12 AS INTEGER) AS contig_number FROM ev) GROUP BY ALL")
def natural_contigs(spark, sf):
    """Contigs in two parts, so that chr2 comes before chr10."""
    rows = events(spark, sf).select(F.concat("contig", (F.col("ord") % 12).cast("string")).alias("contig"))
    return plot_data.contig_order(rows).groupBy("contig", "contig_prefix", "contig_number").agg(F.count("*").alias("n"))


@query("ev", "SELECT strictness_class, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY ALL")
def class_counts(spark, sf):
    return plot_data.class_counts(events(spark, sf), "strictness_class")


@query("ev", "SELECT CASE WHEN turn <= 2 THEN contig ELSE 'other' END AS contig, CAST(sum(n) AS BIGINT) AS count FROM (SELECT *, row_number() OVER (ORDER BY n DESC, contig) AS turn FROM (SELECT contig, count(*) AS n FROM ev GROUP BY contig)) GROUP BY 1")
def top_contigs(spark, sf):
    from cladespark.operators.summaries import top_with_other

    return top_with_other(events(spark, sf).groupBy("contig").count(), "contig", 2)


@query("ev", """SELECT CAST(count(*) FILTER (WHERE side = 0) AS BIGINT) AS n_hits, max(final_score) FILTER (WHERE side = 0) AS best_score, min(final_score) FILTER (WHERE side = 0) AS least_score, CAST(count(*) FILTER (WHERE side = 1) AS BIGINT) AS n_regions, CAST(count(*) AS BIGINT) AS n_evidence FROM ev""")
def run_counters(spark, sf):
    from cladespark.operators.summaries import run_counters as counted

    e = events(spark, sf)
    return counted(e.filter("side = 0"), e.filter("side = 1"), e)


@query(None, "SELECT l_returnflag AS sample, round(avg(coalesce(TRY_CAST(nullif(CASE WHEN l_linenumber = 3 THEN 'NA' ELSE CAST(l_quantity AS VARCHAR) END, 'NA') AS DOUBLE), 0)), 6) AS mean FROM lineitem GROUP BY ALL")
def lenient_means(spark, sf):
    """Means of a text column in which NA and blanks count as 0, as dashboards take them."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.when(F.col("l_linenumber") == 3, "NA").otherwise(F.col("l_quantity").cast("string")).alias("v"))
    return rows.groupBy("sample").agg(F.round(F.avg(tables.lenient("v")), 6).alias("mean"))


@query("loci calls", """, pr AS (SELECT locus_key, sample FROM calls WHERE carry) SELECT CASE WHEN n = 0 THEN 'absent' WHEN n = 5 THEN 'core' WHEN n = 1 THEN 'private' ELSE 'accessory' END AS category, CAST(count(*) AS BIGINT) AS features, CAST(sum(len) AS BIGINT) AS bp, CAST(count(*) FILTER (WHERE t > 0 AND n = t) AS BIGINT) AS target_private
FROM (SELECT locus_key, any_value("end" - start) AS len, count(sample) AS n, count(sample) FILTER (WHERE sample IN ('0', '1')) AS t FROM loci LEFT JOIN pr USING (locus_key) GROUP BY locus_key) GROUP BY 1""")
def pangenome_dashboard(spark, sf):
    """Categories with base pairs, and target-private features among them."""
    from cladespark.plans.catalogue import _matrix

    rows = pangenome.feature_summary(*_matrix(spark, sf), GROUPS)
    return rows.groupBy(F.col("full_category").alias("category")).agg(F.count("*").alias("features"), F.sum("length_bp").cast("long").alias("bp"), F.count_if("target_private").alias("target_private"))


@query("hits", "SELECT locus_key, CASE WHEN start + 5 < \"end\" THEN 'inside' ELSE 'edge' END AS side, CAST(\"end\" - start AS BIGINT) AS length, CAST(greatest(0, greatest(start, 5000) - least(\"end\", 9000)) AS BIGINT) AS distance, (start < 9000 AND 5000 < \"end\") AS overlaps, CASE WHEN start < 9000 AND 5000 < \"end\" AND least(\"end\", 9000) > greatest(start, 5000) THEN (least(\"end\", 9000) - greatest(start, 5000)) / (greatest(\"end\", 9000) - least(start, 5000)) ELSE 0 END AS reciprocal FROM hits")
def locus_geometry(spark, sf):
    """Length, containment, distance, overlap and reciprocal overlap against a fixed interval."""
    from cladespark.operators.intervals import overlaps, reciprocal_overlap
    from cladespark.plans.catalogue import hits

    a, b, lo, hi = F.col("start"), F.col("end"), F.lit(5000), F.lit(9000)
    return hits(spark, sf).select("locus_key", F.when(a + 5 < b, "inside").otherwise("edge").alias("side"), (b - a).cast("long").alias("length"), F.greatest(F.lit(0), F.greatest(a, lo) - F.least(b, hi)).cast("long").alias("distance"), overlaps(a, b, lo, hi).alias("overlaps"), reciprocal_overlap(a, b, lo, hi).alias("reciprocal"))


@query("ev", "SELECT 'CMP' || lpad(CAST(row_number() OVER (ORDER BY ord) AS VARCHAR), 6, '0') AS compare_id, locus_id FROM ev WHERE side = 0")
def compare_ids(spark, sf):
    """Ids of a comparison against nothing, in file order."""
    from cladespark.operators import compare as cmp

    e = events(spark, sf).filter("side = 0").drop("side")
    return cmp.in_output_order(cmp.compare(e, e.limit(0))).select("compare_id", F.col("locus_id_a").alias("locus_id"))

