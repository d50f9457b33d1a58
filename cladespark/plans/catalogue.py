"""The catalogue: one query per operator on the driver's tables, with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladespark.operators import annotate as ann
from cladespark.operators import compare as cmp
from cladespark.operators import kernel, landscape, pangenome
from cladespark.operators.intervals import consecutive_runs, gaps_between, matching, merge_loci, region_rollup, union_of_intervals
from cladespark.operators.windows import bp_windows
from cladespark.plans.driver_tables import COHORT, GROUPS, calls, events, genotypes, items, loci, table, with_sql

RULES = kernel.Thresholds(relaxed_target_missing=0.4, relaxed_offtarget_missing=0.4)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_COUNTS = ["target_support_n", "target_total_n", "offtarget_support_n", "offtarget_total_n", "target_missing_n", "offtarget_missing_n"]
_SUMS = list(landscape.SUMS)
_RATES = ("het", "nonref", "minor_genotype", "rare_alt", "private_alt")


def query(ctes: str | None = None, sql: str | None = None):
    """Register a query, with its oracle if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_sql(ctes, sql) if ctes else sql
        return f

    return register


def _scored_from(counts: str, loci: str) -> dict[str, str]:
    """The common tables graded and scored over other counts and loci, as bodies by name."""
    from cladespark.plans.driver_tables import SQL

    body = lambda name: SQL[name].removeprefix(f"{name} AS (")[:-1]
    return {"graded": body("graded").replace("FROM counts", f"FROM {counts}"), "scored": body("scored").replace("JOIN loci l", f"JOIN {loci} l")}


def graded(spark, sf):
    return kernel.classify(kernel.cohort_counts(calls(spark, sf), COHORT), RULES)


def scored(spark, sf):
    return kernel.score(graded(spark, sf).join(loci(spark, sf), "locus_key"))


def hits(spark, sf):
    return scored(spark, sf).filter("pattern_pass")


def sides(spark, sf):
    e = events(spark, sf)
    return e.filter("side = 0").drop("side"), e.filter("side = 1").drop("side")


# -- discovery kernel ------------------------------------------------------------


@query("counts", "SELECT * FROM counts")
def cohort_counts(spark, sf):
    return kernel.cohort_counts(calls(spark, sf), COHORT)


@query("graded", "SELECT locus_key, strictness_class, pattern_pass FROM graded")
def strictness(spark, sf):
    return graded(spark, sf).select("locus_key", "strictness_class", "pattern_pass")


@query("scored", "SELECT locus_key, discovery_score, support_score, penalty_score, final_score FROM scored")
def discovery_score(spark, sf):
    return scored(spark, sf).select("locus_key", "discovery_score", "support_score", "penalty_score", "final_score")


@query("hits", "SELECT locus_key, contig, final_score, CAST(row_number() OVER (ORDER BY final_score DESC, ord) AS BIGINT) AS rank FROM hits")
def rank_hits(spark, sf):
    return kernel.ranked(hits(spark, sf).select("locus_key", "contig", "final_score", "ord")).select("locus_key", "contig", "final_score", "rank")


@query("hits", "SELECT CAST(row_number() OVER (ORDER BY final_score DESC, ord) AS BIGINT) AS rank, locus_key, final_score FROM hits ORDER BY final_score DESC, ord LIMIT 20")
def topk_hits(spark, sf):
    return kernel.top(hits(spark, sf), 20).select("rank", "locus_key", "final_score")


@query("hits", "SELECT printf('PPX%08d', row_number() OVER (ORDER BY ord)) AS locus_id, locus_key FROM hits")
def locus_ids(spark, sf):
    from cladespark.scan import with_ids

    rows = hits(spark, sf).select("locus_key", F.col("ord").alias("place"))
    return with_ids(rows, "PPX", F.col("place").asc()).select("locus_id", "locus_key")


@query("graded", "SELECT 'alleles_evaluated' AS metric, CAST(count(*) AS BIGINT) AS value FROM graded UNION ALL SELECT 'alleles_passed', count(*) FILTER (WHERE pattern_pass) FROM graded UNION ALL SELECT 'alleles_contradicted', count(*) FILTER (WHERE strictness_class = 'contradicted') FROM graded UNION ALL SELECT 'strictness_' || strictness_class, count(*) FROM graded WHERE pattern_pass GROUP BY strictness_class")
def qc_metrics(spark, sf):
    g = graded(spark, sf)
    one = g.agg(F.count("*").alias("alleles_evaluated"), F.count_if("pattern_pass").alias("alleles_passed"), F.count_if(F.col("strictness_class") == "contradicted").alias("alleles_contradicted"))
    fixed = one.select(F.expr("stack(3, 'alleles_evaluated', alleles_evaluated, 'alleles_passed', alleles_passed, 'alleles_contradicted', alleles_contradicted) as (metric, value)"))
    return fixed.unionByName(g.filter("pattern_pass").groupBy(F.concat(F.lit("strictness_"), "strictness_class").alias("metric")).agg(F.count("*").alias("value")))


# -- regions and intervals ----------------------------------------------------------


@query("merged", 'SELECT contig, CAST(island AS BIGINT) AS island, min(start) AS start, arg_max("end", start) AS "end", CAST(count(*) AS BIGINT) AS n_loci FROM merged GROUP BY contig, island')
def regions_merge(spark, sf):
    return region_rollup(merge_loci(hits(spark, sf), 400)).select("contig", "island", "start", "end", "n_loci")


@query("hits", """, t AS (SELECT *, lag("end") OVER w AS pe, lag(variant_type) OVER w AS pt FROM hits WINDOW w AS (PARTITION BY contig ORDER BY start, ord)),
r AS (SELECT *, sum(CASE WHEN pe IS NULL OR start - pe > 400 OR pt <> variant_type THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, ord) AS island FROM t)
SELECT contig, CAST(island AS BIGINT) AS island, min(start) AS start, arg_max("end", start) AS "end", min(variant_type) AS variant_type, CAST(count(*) AS BIGINT) AS n_loci FROM r GROUP BY contig, island""")
def regions_same_class(spark, sf):
    return region_rollup(merge_loci(hits(spark, sf), 400, same_type=True)).select("contig", "island", "start", "end", F.col("variant_types").alias("variant_type"), "n_loci")


@query("merged", """, c AS (SELECT contig, island, strictness_class, count(*) AS n, min(start) AS f FROM merged GROUP BY ALL),
d AS (SELECT contig, island, strictness_class FROM (SELECT *, row_number() OVER (PARTITION BY contig, island ORDER BY n DESC, f) AS t FROM c) WHERE t = 1)
SELECT m.contig, CAST(m.island AS BIGINT) AS island, string_agg(DISTINCT variant_type, ',' ORDER BY variant_type) AS variant_types, any_value(d.strictness_class) AS dominant_strictness_class,
count(*) FILTER (WHERE target_missing_n = 0) / count(*) AS target_consistency, count(*) FILTER (WHERE offtarget_support_n = 0) / count(*) AS offtarget_exclusion
FROM merged m JOIN d ON m.contig = d.contig AND m.island = d.island GROUP BY m.contig, m.island""")
def regions_rollup(spark, sf):
    return region_rollup(merge_loci(hits(spark, sf), 400)).select("contig", "island", "variant_types", "dominant_strictness_class", "target_consistency", "offtarget_exclusion")


_UNION = """, m AS (SELECT *, max("end") OVER (PARTITION BY contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM m),
u AS (SELECT contig, min(start) AS start, max("end") AS "end" FROM i GROUP BY contig, k)"""


@query("ev", _UNION + ' SELECT contig, start, "end" FROM u')
def presence_union(spark, sf):
    return union_of_intervals(events(spark, sf), ["contig"])


@query("ev", _UNION + ' SELECT contig, start, "end" FROM (SELECT contig, "end" AS start, lead(start) OVER (PARTITION BY contig ORDER BY start) AS "end" FROM u) WHERE "end" > start')
def interval_gaps(spark, sf):
    return gaps_between(union_of_intervals(events(spark, sf), ["contig"]), ["contig"])


@query(None, "SELECT o_custkey, CAST(min(o_orderkey) AS BIGINT) AS first, CAST(max(o_orderkey) AS BIGINT) AS last, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY o_custkey, k")
def site_intervals(spark, sf):
    runs = consecutive_runs(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
    return runs.groupBy("o_custkey", "island").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.count("*").alias("n")).drop("island")


@query("ev", 'SELECT locus_id FROM ev a WHERE side = 0 AND EXISTS (SELECT 1 FROM ev b WHERE b.side = 1 AND b.contig = a.contig AND b.start < a."end" AND a.start < b."end")')
def coverage_semi_join(spark, sf):
    a, b = sides(spark, sf)
    left = a.select("locus_id", F.col("contig").alias("a_contig"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    right = b.select(F.col("contig").alias("b_contig"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return matching(left, right, "locus_id").select("locus_id")


# -- compare -----------------------------------------------------------------------


def _compare_sql(passes: str, score: str, tail: str) -> str:
    return f"""WITH {{EV}},
p AS (SELECT a.locus_id AS locus_id_a, b.locus_id AS locus_id_b, a.ord AS a_ord, b.ord AS b_ord, a.contig, a.start AS sa, a."end" AS ea, b.start AS sb, b."end" AS eb, a.strictness_class AS ca, b.strictness_class AS cb, b.final_score AS score_b,
 greatest(0, least(a."end", b."end") - greatest(a.start, b.start)) AS bp, greatest(0, greatest(a.start, b.start) - least(a."end", b."end")) AS dist FROM ev a JOIN ev b ON a.side = 0 AND b.side = 1 AND a.contig = b.contig AND b.start <= a."end" + 200 AND b."end" >= a.start - 200),
q AS (SELECT *, CASE WHEN bp > 0 THEN bp / (greatest(ea, eb) - least(sa, sb)) ELSE 0 END AS reciprocal, CASE WHEN bp > 0 THEN least(1, greatest(bp / (ea - sa), bp / (eb - sb))) ELSE 0 END AS containment FROM p),
o AS (SELECT *, {score} AS overlap, 'overlap' AS method FROM q WHERE bp > 0 AND {passes}),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_ord ORDER BY dist, sb, eb, b_ord) AS t FROM q WHERE dist <= 200 AND a_ord NOT IN (SELECT a_ord FROM o)) WHERE t = 1),
f AS (SELECT locus_id_a, locus_id_b, a_ord, ca, cb, overlap, method FROM o UNION ALL SELECT locus_id_a, locus_id_b, a_ord, ca, cb, 0, 'breakpoint' FROM n),
m AS (SELECT *, CASE WHEN ca = 'contradicted' OR cb = 'contradicted' THEN 'contradicted' WHEN overlap <= 0 THEN 'partially_supported' ELSE 'supported' END AS match_class FROM f)
{tail}"""


def _ev(sql: str) -> str:
    from cladespark.plans.driver_tables import SQL

    return sql.replace("{EV}", SQL["ev"])


_SCORE = "round(CASE match_class WHEN 'supported' THEN 1.0::DOUBLE * greatest(overlap, 0.01::DOUBLE) WHEN 'partially_supported' THEN 0.5::DOUBLE * greatest(overlap, 0.01::DOUBLE) WHEN 'source_specific' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END, 4)"
_PAIR_TAIL = f"SELECT locus_id_a, locus_id_b, CAST(overlap AS DOUBLE) AS overlap, method, match_class, {_SCORE} AS comparison_score FROM m"


def _pairs(mode: str):
    def run(spark, sf):
        a, b = sides(spark, sf)
        return cmp.matches(a, b, cmp.CompareRules(overlap_mode=mode)).select("locus_id_a", "locus_id_b", "overlap", "method", "match_class", "comparison_score")

    return run


for _mode, _passes, _score in (("any", "true", "containment"), ("reciprocal", "reciprocal >= 0.5", "reciprocal"), ("contained", "containment >= 0.5", "containment")):
    QUERIES[f"compare_{_mode}"] = _pairs(_mode)
    ORACLES[f"compare_{_mode}"] = _ev(_compare_sql(_passes, _score, _PAIR_TAIL))


@query(None, _ev(_compare_sql("containment >= 0.5", "containment", "SELECT locus_id_a, locus_id_b, match_class FROM m WHERE method = 'breakpoint'")))
def compare_breakpoint(spark, sf):
    a, b = sides(spark, sf)
    return cmp.matches(a, b).filter("method = 'breakpoint'").select("locus_id_a", "locus_id_b", "match_class")


_ALONE = """SELECT locus_id AS locus_id_a, NULL AS locus_id_b, 'source_specific' AS match_class FROM ev WHERE side = 0 AND ord NOT IN (SELECT a_ord FROM m)
UNION ALL SELECT NULL, locus_id, 'source_specific' FROM ev WHERE side = 1 AND locus_id NOT IN (SELECT locus_id_b FROM m)"""


@query(None, _ev(_compare_sql("containment >= 0.5", "containment", _ALONE)))
def compare_unmatched(spark, sf):
    a, b = sides(spark, sf)
    return cmp.compare(a, b).filter("match_class = 'source_specific'").select("locus_id_a", "locus_id_b", "match_class")


@query(None, _ev(_compare_sql("containment >= 0.5", "containment", f""", z AS (SELECT match_class, overlap FROM m UNION ALL SELECT match_class, NULL FROM ({_ALONE}))
SELECT c.match_class, CAST(count(z.match_class) AS BIGINT) AS n_loci, round(100.0::DOUBLE * count(z.match_class) / (SELECT count(*) FROM z), 6) AS pct_total, round(avg(overlap), 3) AS mean_overlap FROM (VALUES ('supported'), ('partially_supported'), ('contradicted'), ('source_specific'), ('uninformative'), ('novel')) c(match_class) LEFT JOIN z USING (match_class) GROUP BY ALL""")))
def compare_summary(spark, sf):
    a, b = sides(spark, sf)
    return cmp.summary(cmp.compare(a, b)).select("match_class", "n_loci", F.round("pct_total", 6).alias("pct_total"), F.round("mean_overlap", 3).alias("mean_overlap"))


# -- annotation and export -------------------------------------------------------------

_GENES = """, genes AS (SELECT locus_id AS gene_id, contig, start, "end" + 300 AS "end", ord FROM ev WHERE side = 1), parts AS (SELECT contig, start, "end", CASE ord % 3 WHEN 0 THEN 'CDS' WHEN 1 THEN 'three_prime_UTR' ELSE 'exon' END AS type FROM ev WHERE side = 1), q AS (SELECT * FROM ev WHERE side = 0)"""


def _annotated(spark, sf):
    """Every event: those of side 0 are the loci, those of side 1 the genes and their parts."""
    a, b = sides(spark, sf)
    genes = b.select(F.col("locus_id").alias("gene_id"), "contig", "start", (F.col("end") + 300).alias("end"), F.lit("+").alias("strand"), "ord")
    return a, genes, b.select("contig", "start", "end", F.expr("case ord % 3 when 0 then 'CDS' when 1 then 'three_prime_UTR' else 'exon' end").alias("type"))


_ANN = _GENES + """, g AS (SELECT ord, gene_id FROM (SELECT q.ord, gene_id, row_number() OVER (PARTITION BY q.ord ORDER BY g.start, g.ord) AS t FROM q JOIN genes g ON q.contig = g.contig AND q.start < g."end" AND g.start < q."end") WHERE t = 1),
k AS (SELECT q.ord, max(CASE WHEN type = 'CDS' THEN 3 WHEN type LIKE '%UTR%' THEN 2 ELSE 1 END) AS kind FROM q JOIN parts p ON q.contig = p.contig AND q.start < p."end" AND p.start < q."end" GROUP BY q.ord),
a AS (SELECT q.locus_id, g.gene_id, CASE WHEN g.gene_id IS NULL THEN 'intergenic' WHEN kind = 3 THEN 'CDS' WHEN kind = 2 THEN 'UTR' WHEN kind = 1 THEN 'exon' ELSE 'intronic' END AS annotation_class FROM q LEFT JOIN g USING (ord) LEFT JOIN k USING (ord))"""


@query("ev", _ANN + " SELECT locus_id, gene_id, annotation_class FROM a")
def annotate_hierarchy(spark, sf):
    return ann.annotate(*_annotated(spark, sf)).select("locus_id", "gene_id", "annotation_class")


@query("ev", _ANN + " SELECT c.annotation_class, CAST(count(a.locus_id) AS BIGINT) AS n_loci, round(100.0::DOUBLE * count(a.locus_id) / (SELECT count(*) FROM a), 9) AS pct_total FROM (VALUES ('CDS'), ('UTR'), ('exon'), ('intronic'), ('intergenic')) c(annotation_class) LEFT JOIN a USING (annotation_class) GROUP BY ALL")
def annotation_summary(spark, sf):
    return ann.annotation_summary(ann.annotate(*_annotated(spark, sf))).select("annotation_class", "n_loci", F.round("pct_total", 9).alias("pct_total"))


@query("ev", _GENES + """, d AS (SELECT q.locus_id, q.ord, g.gene_id, g.start, g."end", greatest(0, g.start - (q."end" - 1), q.start - (g."end" - 1)) AS distance FROM q JOIN genes g ON q.contig = g.contig),
b AS (SELECT ord, arg_min(gene_id, (distance, start, "end", gene_id)) AS gene_id, min(distance) AS distance FROM d GROUP BY ord) SELECT q.locus_id, b.gene_id, CAST(b.distance AS BIGINT) AS distance FROM q LEFT JOIN b USING (ord)""")
def annotate_nearest(spark, sf):
    loci_, genes, _ = _annotated(spark, sf)
    return ann.nearest_gene(loci_, genes).select("locus_id", "gene_id", "distance")


@query("hits", """SELECT contig || chr(9) || start || chr(9) || "end" || chr(9) || 'K' || locus_key || chr(9) || CAST(round(least(greatest(final_score * 1000, 0), 1000)) AS BIGINT) || chr(9) || '.' AS line FROM hits""")
def export_bed(spark, sf):
    from cladespark.sinks import bed_line

    rows = hits(spark, sf).withColumn("locus_id", F.concat(F.lit("K"), "locus_key"))
    return rows.select(bed_line("locus_id", "final_score").alias("line"))


@query("hits", """SELECT contig || chr(9) || 'cladespark' || chr(9) || 'sequence_variant' || chr(9) || (start + 1) || chr(9) || greatest("end", start + 1) || chr(9) || '.' || chr(9) || '.' || chr(9) || '.' || chr(9) || 'ID=K' || locus_key || ';variant_type=' || variant_type || ';strictness_class=' || strictness_class AS line FROM hits""")
def export_gff3(spark, sf):
    from cladespark.sinks import gff3_line

    rows = hits(spark, sf).withColumn("ID", F.concat(F.lit("K"), "locus_key"))
    return rows.select(gff3_line(None, ["ID", "variant_type", "strictness_class"]).alias("line"))


# -- pangenome ----------------------------------------------------------------------

_PAN = """, f AS (SELECT locus_key AS feature_id, "end" - start AS length_bp FROM loci), pr AS (SELECT locus_key AS feature_id, sample FROM calls WHERE carry),
gb(grp, sample) AS (VALUES ('full', '0'), ('full', '1'), ('full', '2'), ('full', '3'), ('full', '4'), ('target', '0'), ('target', '1'), ('off_target', '2'), ('off_target', '3'), ('off_target', '4')),
gs AS (SELECT grp, count(*) AS size FROM gb GROUP BY grp),
fc AS (SELECT feature_id, length_bp, grp, size, count(pr.sample) AS present_n FROM f CROSS JOIN gs LEFT JOIN (SELECT gb.grp AS g2, pr.* FROM gb JOIN pr USING (sample)) pr ON pr.g2 = gs.grp AND pr.feature_id = f.feature_id GROUP BY ALL)""".replace("LEFT JOIN (SELECT gb.grp AS g2, pr.* FROM gb JOIN pr USING (sample)) pr ON pr.g2 = gs.grp AND pr.feature_id = f.feature_id GROUP BY ALL", "LEFT JOIN (SELECT gb.grp AS g2, pr.feature_id AS fid, pr.sample FROM gb JOIN pr USING (sample)) pr ON pr.g2 = gs.grp AND pr.fid = f.feature_id GROUP BY ALL")
_CAT = "CASE WHEN present_n = 0 THEN 'absent' WHEN present_n = size THEN 'core' WHEN present_n = 1 THEN 'private' ELSE 'accessory' END"


def _matrix(spark, sf):
    f = loci(spark, sf).select(F.col("locus_key").alias("feature_id"), (F.col("end") - F.col("start")).alias("length_bp"))
    return f, calls(spark, sf).filter("state = 'carry'").select(F.col("locus_key").alias("feature_id"), "sample")


@query("loci calls", _PAN + f""" SELECT feature_id, CAST(length_bp AS BIGINT) AS length_bp, CAST(max(present_n) FILTER (WHERE grp = 'full') AS BIGINT) AS full_present_n, CAST(max(present_n) FILTER (WHERE grp = 'target') AS BIGINT) AS target_present_n, CAST(max(present_n) FILTER (WHERE grp = 'off_target') AS BIGINT) AS off_target_present_n,
max({_CAT}) FILTER (WHERE grp = 'full') AS full_category FROM fc GROUP BY feature_id, length_bp""")
def feature_summary(spark, sf):
    out = pangenome.feature_summary(*_matrix(spark, sf), GROUPS)
    return out.select("feature_id", F.col("length_bp").cast("long").alias("length_bp"), "full_present_n", "target_present_n", "off_target_present_n", "full_category")


@query("loci calls", _PAN + " SELECT k.grp, CAST(k.present_n AS BIGINT) AS present_n, CAST(count(fc.feature_id) AS BIGINT) AS features, CAST(coalesce(sum(length_bp), 0) AS BIGINT) AS bp FROM (SELECT grp, unnest(range(size + 1)) AS present_n FROM gs) k LEFT JOIN fc ON fc.grp = k.grp AND fc.present_n = k.present_n GROUP BY ALL")
def coverage_histogram(spark, sf):
    return pangenome.coverage_histogram(*_matrix(spark, sf), GROUPS)


@query("loci calls", _PAN + f", c AS (SELECT *, {_CAT} AS category FROM fc) SELECT g.grp, k.category, CAST(count(c.feature_id) AS BIGINT) AS features, CAST(coalesce(sum(length_bp), 0) AS BIGINT) AS bp FROM gs g CROSS JOIN (VALUES ('absent'), ('private'), ('accessory'), ('core')) k(category) LEFT JOIN c ON c.grp = g.grp AND c.category = k.category GROUP BY ALL")
def composition(spark, sf):
    return pangenome.composition(*_matrix(spark, sf), GROUPS)


_TRIALS = pangenome.permutations(GROUPS, 100, 42)


_GROWTH = ", f AS (SELECT locus_key AS feature_id, \"end\" - start AS length_bp FROM loci), pr AS (SELECT locus_key AS feature_id, sample FROM calls WHERE carry), pl(grp, trial, sample, place) AS (VALUES " + ", ".join(f"('{g}', {t}, '{s}', {n})" for g, t, s, n in _TRIALS) + """),
r AS (SELECT grp, trial, pr.feature_id, place, row_number() OVER (PARTITION BY grp, trial, pr.feature_id ORDER BY place) AS k FROM pl JOIN pr USING (sample)),
m AS (SELECT grp, trial, feature_id, min(place) AS p1, min(place) FILTER (WHERE k = 2) AS p2 FROM r GROUP BY ALL),
g AS (SELECT l.grp, CAST(l.trial AS INTEGER) AS trial, CAST(l.place AS INTEGER) AS n, CAST(count(*) FILTER (WHERE p1 <= place) AS BIGINT) AS features, CAST(coalesce(sum(length_bp) FILTER (WHERE p1 <= place), 0) AS BIGINT) AS bp, CAST(count(*) FILTER (WHERE p1 = place) AS BIGINT) AS new_features, CAST(coalesce(sum(length_bp) FILTER (WHERE p1 = place), 0) AS BIGINT) AS new_bp, CAST(count(*) FILTER (WHERE p1 <= place AND (p2 IS NULL OR p2 > place)) AS BIGINT) AS singletons
FROM pl l JOIN m ON m.grp = l.grp AND m.trial = l.trial JOIN f USING (feature_id) GROUP BY l.grp, l.trial, l.place)"""


@query("loci calls", _GROWTH + " SELECT * FROM g")
def growth_curve(spark, sf):
    return pangenome.growth_curves(*_matrix(spark, sf), GROUPS, 100, 42)


@query("loci calls", _GROWTH + " SELECT grp, n, round(avg(features), 6) AS mean_features, round(avg(bp), 6) AS mean_bp, round(quantile_cont(features, 0.025), 6) AS low, round(quantile_cont(features, 0.975), 6) AS high FROM g GROUP BY grp, n")
def growth_quantiles(spark, sf):
    out = pangenome.growth_summary(pangenome.growth_curves(*_matrix(spark, sf), GROUPS, 100, 42))
    return out.select("grp", "n", *[F.round(c, 6).alias(c) for c in ("mean_features", "mean_bp", "low", "high")])


# -- landscape ------------------------------------------------------------------------


@query("records gts", """SELECT coalesce(reason, 'kept') AS skip_reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT contig, i, CASE WHEN count(*) FILTER (WHERE g IS NULL) / 5 > 0.4 THEN 'site_missing_rate' WHEN count(*) FILTER (WHERE g IN ('01', '11')) < 2 THEN 'min_alt_carriers' WHEN count(*) FILTER (WHERE g IN ('01', '11')) / 5 > 0.6 THEN 'max_alt_carrier_freq' END AS reason FROM gts GROUP BY contig, i) GROUP BY ALL""")
def filter_cascade(spark, sf):
    g = genotypes(spark, sf).groupBy("contig", "i").agg(F.collect_list(F.struct(F.col("gt"))).alias("x"))
    rows = g.select("contig", "i", F.lit("A").alias("ref"), F.array(F.lit("T")).alias("alts"), F.lit(None).cast("double").alias("qual"), F.array().cast("array<string>").alias("filters"), F.col("x.gt").alias("gts"))
    marked = landscape.filter_reason(rows, max_missing_rate=0.4, min_carriers=2, max_freq=0.6)
    return marked.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("skip_reason")).agg(F.count("*").alias("n"))


@query("wins records", """SELECT w.contig, w.w, CAST(count(*) AS BIGINT) AS n_variants, min(r.start) AS start, max(r."end") AS "end" FROM wins w JOIN records r ON r.contig = w.contig AND r.i >= w.lo AND r.i < w.hi GROUP BY ALL""")
def record_windows(spark, sf):
    marks = landscape.variant_marks(genotypes(spark, sf))
    return landscape.window_extent(marks, 20, 10).select("contig", "w", "n_variants", "start", "end")


@query("ev", """, b AS (SELECT contig, min(start) AS base, greatest(0, CAST(ceil((max("end") - min(start) - 7200) / 3600) AS BIGINT)) AS last FROM ev GROUP BY contig), g AS (SELECT e.*, base, unnest(range(greatest(0, CAST(floor((start - base - 7200) / 3600) AS BIGINT) + 1), least(CAST(floor(("end" - 1 - base) / 3600) AS BIGINT), last) + 1)) AS grid FROM ev e JOIN b USING (contig)),
h AS (SELECT * FROM g WHERE start < base + grid * 3600 + 7200 AND "end" > base + grid * 3600) SELECT contig, CAST(dense_rank() OVER (PARTITION BY contig ORDER BY grid) - 1 AS BIGINT) AS w, n, start, "end" FROM (SELECT contig, grid, CAST(count(*) AS BIGINT) AS n, min(start) AS start, max("end") AS "end" FROM h GROUP BY contig, grid)""")
def bp_window_counts(spark, sf):
    rows = bp_windows(events(spark, sf).select("contig", "start", "end"), 7200, 3600)
    return rows.groupBy("contig", F.col("w").cast("long").alias("w")).agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))


def _windowed(spark, sf):
    marks = landscape.variant_marks(genotypes(spark, sf), min_called_for_freq=2)
    return marks, landscape.sample_windows(marks, 20, 10, 3)


@query("sw", "SELECT contig, w, sample, " + ", ".join(_SUMS) + ", missing_n / n_variants AS missing_rate, " + ", ".join(f"CASE WHEN called_n > 0 THEN {c}_n / called_n END AS {c}_rate" for c in _RATES) + " FROM sw")
def window_sample_metrics(spark, sf):
    return _windowed(spark, sf)[1].select("contig", "w", "sample", *_SUMS, "missing_rate", *[f"{c}_rate" for c in _RATES])


@query("marks", "SELECT contig, CAST(i AS INTEGER) AS i, sample, CAST(minor_gt AS BIGINT) AS minor_genotype_n, CAST(rare AS BIGINT) AS rare_alt_n, CAST(private AS BIGINT) AS private_alt_n, call_freq FROM marks")
def minor_genotype(spark, sf):
    return landscape.variant_marks(genotypes(spark, sf), min_called_for_freq=2).select("contig", "i", "sample", "minor_genotype_n", "rare_alt_n", "private_alt_n", "call_freq")


@query("sw", "SELECT contig, w, sample, median_call_freq FROM sw")
def call_freq_median(spark, sf):
    return _windowed(spark, sf)[1].select("contig", "w", "sample", "median_call_freq")


@query("pairs", "SELECT * FROM pairs")
def pairwise_similarity(spark, sf):
    return landscape.pair_similarity(genotypes(spark, sf), 20, 10).select("contig", "w", "sample_a", "sample_b", F.col("compared").cast("long").alias("compared"), F.col("matches").cast("long").alias("matches"), "similarity")


@query("near", "SELECT contig, w, sample, nearest, nearest_similarity, nearest_compared FROM near")
def nearest_background(spark, sf):
    pairs = landscape.pair_similarity(genotypes(spark, sf), 20, 10)
    return landscape.nearest_background(pairs).withColumn("nearest_compared", F.col("nearest_compared").cast("long"))


def _with_nearest(spark, sf):
    from cladespark.operators.ordering import stored

    records = stored(landscape.records_of(genotypes(spark, sf)), "records")
    marks = stored(landscape.variant_marks(records, min_called_for_freq=2), "marks")  # read by sums, medians, extents
    rows = landscape.sample_windows(marks, 20, 10, 3)
    pairs = stored(landscape.pair_similarity(records, 20, 10), "pairs")
    near = landscape.nearest_background(pairs)
    own = landscape.nearest_background(pairs, COHORT.targets).select("contig", "w", "sample", F.col("nearest_similarity").alias("target_similarity"))
    role = F.when(F.col("nearest").isin(*COHORT.targets), "target").otherwise("off_target")
    return rows.join(near.withColumn("nearest_role", role), ["contig", "w", "sample"], "left").join(own, ["contig", "w", "sample"], "left")


_SWN = """, swn AS (SELECT sw.*, near.nearest, round(near.nearest_similarity, 6) AS sim, CASE WHEN near.nearest IN ('0', '1') THEN 'target' WHEN near.nearest IS NOT NULL THEN 'off_target' END AS nrole, round(missing_n / n_variants, 6) AS lost FROM sw LEFT JOIN near USING (contig, w, sample))"""


@query("sw near", _SWN + """, x AS (SELECT *, CASE WHEN sim >= 0.5 THEN nearest ELSE 'unassigned' END AS nn FROM swn), y AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> nn THEN 1 ELSE 0 END) OVER (PARTITION BY sample, contig ORDER BY w) AS k FROM (SELECT *, lag(nn) OVER (PARTITION BY sample, contig ORDER BY w) AS p FROM x))
SELECT sample, contig, arg_min(start, w) AS start, arg_max("end", w) AS "end", CAST(count(*) AS BIGINT) AS n_windows, min(nn) AS nearest_background, min(CASE WHEN nn = 'unassigned' THEN nn ELSE nrole END) AS nearest_background_role, min(role) AS cohort_role, round(avg(CASE WHEN nn <> 'unassigned' THEN sim END), 9) AS mean_similarity FROM y GROUP BY sample, contig, k""")
def background_blocks(spark, sf):
    return landscape.background_blocks(_with_nearest(spark, sf), 0.5).select("sample", "contig", "start", "end", "n_windows", "nearest_background", "nearest_background_role", "cohort_role", F.round("mean_similarity", 9).alias("mean_similarity"))


@query("sw near pairs", _SWN + """, tn AS (SELECT contig, w, sample, max(similarity) AS ts FROM (SELECT contig, w, sample_a AS sample, sample_b AS other, similarity FROM pairs UNION ALL SELECT contig, w, sample_b, sample_a, similarity FROM pairs) WHERE other IN ('0', '1') GROUP BY ALL),
c AS (SELECT swn.*, ts FROM swn LEFT JOIN tn USING (contig, w, sample) WHERE role = 'target' AND nrole = 'off_target' AND sim >= 0.4 AND lost <= 0.9 AND (ts IS NULL OR sim - ts >= 0.01)),
y AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> nearest OR pw + 1 <> w THEN 1 ELSE 0 END) OVER (PARTITION BY sample, contig ORDER BY w) AS k FROM (SELECT *, lag(nearest) OVER (PARTITION BY sample, contig ORDER BY w) AS p, lag(w) OVER (PARTITION BY sample, contig ORDER BY w) AS pw FROM c))
SELECT sample, contig, arg_min(start, w) AS start, arg_max("end", w) AS "end", CAST(count(*) AS BIGINT) AS n_windows, min(nearest) AS candidate_donor, max(lost) AS max_missing_rate, round(avg(sim), 9) AS mean_donor_similarity, round(avg(ts), 9) AS mean_nearest_target_similarity, round(avg(sim - ts), 9) AS mean_similarity_delta, round(avg(round(private_alt_n / called_n, 6)), 9) AS mean_private_alt_rate, round(avg(round(nonref_n / called_n, 6)), 9) AS mean_nonref_rate,
CASE WHEN avg(sim - ts) IS NULL THEN 'donor_like_single_target' WHEN avg(sim - ts) > 0 THEN 'offtarget_closer_than_target' ELSE 'candidate_introgression' END AS evidence_class FROM y GROUP BY sample, contig, k HAVING count(*) >= 2""")
def introgression_blocks(spark, sf):
    out = landscape.introgression_blocks(_with_nearest(spark, sf), 0.4, 0.01, 0.9, 2)
    return out.select("sample", "contig", "start", "end", "n_windows", "candidate_donor", "max_missing_rate", *[F.round(c, 9).alias(c) for c in ("mean_donor_similarity", "mean_nearest_target_similarity", "mean_similarity_delta", "mean_private_alt_rate", "mean_nonref_rate")], "evidence_class")


@query("pairs", "SELECT sample_a, sample_b, CAST(count(*) AS BIGINT) AS n_windows, CAST(sum(compared) AS BIGINT) AS compared_variants, round(avg(similarity), 5) AS mean_similarity FROM pairs GROUP BY ALL")
def similarity_summary(spark, sf):
    pairs = landscape.pair_similarity(genotypes(spark, sf), 20, 10)
    out = landscape.similarity_summary(pairs)
    return out.select("sample_a", "sample_b", "n_windows", F.col("compared_variants").cast("long").alias("compared_variants"), F.round("mean_similarity", 5).alias("mean_similarity"))


@query()
def local_pca(spark, sf):
    """Classical scaling per window; signs of axes are arbitrary, so there is no SQL oracle."""
    pairs = landscape.pair_similarity(genotypes(spark, sf), 20, 10)
    return landscape.local_pca(pairs, GROUPS["full"])


# -- reports, plots, dashboards -----------------------------------------------------------


@query("hits", "SELECT c.strictness_class, CAST(count(h.locus_key) AS BIGINT) AS n_loci, round(100.0::DOUBLE * count(h.locus_key) / (SELECT count(*) FROM hits), 1) AS pct_hits FROM (VALUES ('strict_complete'), ('strict_target_missing'), ('strict_offtarget_missing'), ('strict_both_missing'), ('relaxed_threshold')) c(strictness_class) LEFT JOIN hits h USING (strictness_class) GROUP BY ALL")
def strictness_summary(spark, sf):
    from cladespark.operators.summaries import strictness_summary as summed

    return summed(hits(spark, sf)).drop("place")


@query(None, "SELECT source_type, evidence_class, CAST(n AS BIGINT) AS n_records, n / sum(n) OVER (PARTITION BY source_type) AS share FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'vcf' ELSE 'bam' END AS source_type, l_returnflag AS evidence_class, count(*) AS n FROM lineitem GROUP BY ALL)")
def support_summary(spark, sf):
    from cladespark.operators.summaries import support_summary as summed

    lines = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "vcf").otherwise("bam").alias("source_type"), F.col("l_returnflag").alias("evidence_class"))
    return summed(lines)


@query("hits", """, e AS (SELECT max(final_score) + 0.05 AS top, least(count(*) + 2, 30) - 1 AS bins FROM hits) SELECT strictness_class, CAST(least(floor(final_score / (top / bins)), bins - 1) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM hits, e GROUP BY ALL""")
def score_histogram(spark, sf):
    from cladespark.operators.summaries import score_histogram as binned

    return binned(hits(spark, sf))


@query("hits", """, r AS (SELECT contig, min(start) AS lo, max(start) AS hi FROM hits GROUP BY contig), b AS (SELECT contig, lo, unnest(range((hi - lo) // 50000 + 1)) AS bin FROM r) SELECT b.contig, CAST(b.bin AS BIGINT) AS bin, CAST(count(h.locus_key) AS BIGINT) AS n FROM b LEFT JOIN hits h ON h.contig = b.contig AND (h.start - b.lo) // 50000 = b.bin GROUP BY ALL""")
def density_bins(spark, sf):
    from cladespark.operators.summaries import density_bins as binned

    return binned(hits(spark, sf), 50_000)


@query("ev", _GENES + """, s AS (SELECT g.gene_id, g.start, count(v.ord) FILTER (WHERE v.ord % 3 = 0) + 2 * count(v.ord) FILTER (WHERE v.ord % 3 = 1) + 4 * count(v.ord) FILTER (WHERE v.ord % 3 = 2) AS score FROM genes g LEFT JOIN q v ON v.contig = g.contig AND v.start < g."end" AND g.start < v."end" GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY score DESC, start, gene_id) AS BIGINT) AS rank, gene_id, CAST(score AS BIGINT) AS rank_score FROM s WHERE score > 0 ORDER BY score DESC, start, gene_id LIMIT 50""")
def candidate_rank(spark, sf):
    from cladespark.operators.summaries import candidate_features

    sites, genes, _ = _annotated(spark, sf)
    sites = sites.withColumn("display_type", F.expr("case ord % 3 when 0 then 'SNP' when 1 then 'INDEL' else 'SV-like' end"))
    return candidate_features(ann.feature_counts(genes, sites), 50).select("rank", "gene_id", "rank_score")
