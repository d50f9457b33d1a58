"""Cohort-shaped views of the star-schema tables, so that every operator runs on them.

A locus is a part: contig = brand, 40 bases apart, as long as its size. A sample
is a customer nation. A cell (part, nation) carries if any of its line items was
returned, is absent if it has line items and none was, and is missing without.
Intervals are events: contig = type, start = second, length from the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.cohort import Cohort

TARGETS, OFF_TARGETS = (0, 1), (2, 3, 4)
COHORT = Cohort(tuple(map(str, TARGETS)), tuple(map(str, OFF_TARGETS)))
GROUPS = {"full": ("0", "1", "2", "3", "4"), "target": ("0", "1"), "off_target": ("2", "3", "4")}
CLASSES = ("strict_complete", "strict_target_missing", "relaxed_threshold", "contradicted", "strict_both_missing")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of the cohort's nations: only the needed columns and nations go into the joins."""
    customer = table(spark, sf_dir, "customer").filter(F.col("c_nationkey").isin(*TARGETS, *OFF_TARGETS)).select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    own = lines.join(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return own.select(F.col("l_partkey").alias("locus_key"), F.col("c_nationkey").cast("string").alias("sample"), "l_returnflag")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = items(spark, sf_dir).groupBy("locus_key", "sample").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    return cells.select("locus_key", "sample", F.when(F.col("r") == 1, "carry").otherwise("absent").alias("state"))


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") == 1, "snp").when(F.col("p_size") <= 25, "indel").otherwise("sv")
    start = F.col("p_partkey") * 40
    return p.select(F.col("p_partkey").alias("locus_key"), F.col("p_brand").alias("contig"), start.alias("start"), (start + F.col("p_size")).alias("end"), kind.alias("variant_type"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_size").cast("double")).alias("qual"), F.col("p_partkey").alias("ord"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    klass = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.concat(F.lit("E"), F.col("event_id")).alias("locus_id"), F.col("event_type").alias("contig"), start.alias("start"), (start + 1 + F.floor("value").cast("long")).alias("end"), klass.alias("strictness_class"), ((F.col("event_id") % 7) / 8.0).alias("final_score"), F.col("event_id").alias("ord"), (F.col("user_id") % 2).alias("side"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table of the landscape: one row per part and nation; the genotype is null without line items."""
    cells = items(spark, sf_dir).groupBy("locus_key", "sample").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.max((F.col("l_returnflag") == "A").cast("int")).alias("a"))
    names = F.array(*[F.lit(s) for s in GROUPS["full"]])
    from cladespark.operators.windows import record_index

    records = record_index(loci(spark, sf_dir).select("locus_key", "contig", "start", "end"), ["contig"], "start")
    wide = records.withColumn("sample", F.explode(names)).join(cells, ["locus_key", "sample"], "left")
    role = F.when(F.col("sample").isin(*COHORT.targets), "target").otherwise("off_target")
    return wide.select("contig", F.col("i").cast("int").alias("i"), "n", "start", "end", "sample", role.alias("role"), F.when(F.col("r").isNotNull(), F.array("r", "a")).alias("gt"))


#: The same views in SQL.
SQL = {
    "items": "items AS (SELECT l_partkey AS locus_key, CAST(c_nationkey AS VARCHAR) AS sample, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (0, 1, 2, 3, 4))",
    "calls": "calls AS (SELECT locus_key, sample, bool_or(l_returnflag = 'R') AS carry FROM items GROUP BY ALL)",
    "counts": """counts AS (SELECT locus_key, CAST(count(*) FILTER (WHERE carry AND sample IN ('0', '1')) AS BIGINT) AS target_support_n, CAST(2 AS BIGINT) AS target_total_n,
      CAST(count(*) FILTER (WHERE carry AND sample NOT IN ('0', '1')) AS BIGINT) AS offtarget_support_n, CAST(3 AS BIGINT) AS offtarget_total_n,
      CAST(2 - count(*) FILTER (WHERE sample IN ('0', '1')) AS BIGINT) AS target_missing_n, CAST(3 - count(*) FILTER (WHERE sample NOT IN ('0', '1')) AS BIGINT) AS offtarget_missing_n FROM calls GROUP BY locus_key)""",
    "loci": "loci AS (SELECT p_partkey AS locus_key, p_brand AS contig, p_partkey * 40 AS start, p_partkey * 40 + p_size AS \"end\", CASE WHEN p_size = 1 THEN 'snp' WHEN p_size <= 25 THEN 'indel' ELSE 'sv' END AS variant_type, CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_size AS DOUBLE) END AS qual, p_partkey AS ord FROM part)",
    "graded": """graded AS (SELECT *, CASE WHEN p_o > 0 THEN 'contradicted' WHEN p_t IS NULL THEN CASE WHEN offtarget_missing_n > 0 THEN 'strict_both_missing' ELSE 'strict_target_missing' END
      WHEN p_t < 1 THEN 'relaxed_threshold' WHEN target_missing_n = 0 AND offtarget_missing_n = 0 THEN 'strict_complete' WHEN target_missing_n / 2 > 0.4 OR offtarget_missing_n / 3 > 0.4 THEN 'relaxed_threshold'
      WHEN target_missing_n > 0 AND offtarget_missing_n > 0 THEN 'strict_both_missing' WHEN target_missing_n > 0 THEN 'strict_target_missing' ELSE 'strict_offtarget_missing' END AS strictness_class,
      NOT (coalesce(p_o, 0) > 0 OR p_t IS NULL OR p_t < 1) AS pattern_pass
      FROM (SELECT *, CASE WHEN target_missing_n < 2 THEN target_support_n / (2 - target_missing_n) END AS p_t, CASE WHEN offtarget_missing_n < 3 THEN offtarget_support_n / (3 - offtarget_missing_n) END AS p_o FROM counts))""",
    "scored": """scored AS (SELECT *, round(discovery_score + support_score - penalty_score, 6) AS final_score FROM (SELECT g.*, l.contig, l.start, l."end", l.variant_type, l.qual, l.ord,
      round(least((coalesce(p_t, 0) + (1 - coalesce(p_o, 0))) / 2 + CASE WHEN strictness_class = 'strict_complete' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN qual IS NULL THEN 0 ELSE least(qual / 60.0::DOUBLE, 1) * 0.1::DOUBLE END, 2.0::DOUBLE), 6) AS discovery_score, 0.0::DOUBLE AS support_score,
      CASE WHEN strictness_class = 'contradicted' THEN 0.8::DOUBLE ELSE round(least(target_missing_n / 2 * 0.4::DOUBLE + offtarget_missing_n / 3 * 0.3::DOUBLE, 1) * 0.8::DOUBLE, 6) END AS penalty_score
      FROM graded g JOIN loci l USING (locus_key)))""",
    "hits": "hits AS (SELECT * FROM scored WHERE pattern_pass)",
    "merged": """merged AS (SELECT *, sum(CASE WHEN pe IS NULL OR start - pe > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, ord) AS island
      FROM (SELECT *, lag("end") OVER (PARTITION BY contig ORDER BY start, ord) AS pe FROM hits))""",
    "ev": """ev AS (SELECT 'E' || event_id AS locus_id, event_type AS contig, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + 1 + CAST(floor(value) AS BIGINT) AS "end",
      (['strict_complete', 'strict_target_missing', 'relaxed_threshold', 'contradicted', 'strict_both_missing'])[event_id % 5 + 1] AS strictness_class, (event_id % 7) / 8.0::DOUBLE AS final_score, event_id AS ord, user_id % 2 AS side FROM events)""",
    "records": "records AS (SELECT locus_key, contig, start, \"end\", row_number() OVER (PARTITION BY contig ORDER BY start) - 1 AS i, count(*) OVER (PARTITION BY contig) AS n FROM loci)",
    "gts": """gts AS (SELECT r.contig, r.i, r.n, r.start, r."end", s.sample, CASE WHEN s.sample IN ('0', '1') THEN 'target' ELSE 'off_target' END AS role, CASE WHEN c.r IS NOT NULL THEN CASE WHEN c.r + c.a = 0 THEN '00' WHEN c.r + c.a = 1 THEN '01' ELSE '11' END END AS g
      FROM records r CROSS JOIN (VALUES ('0'), ('1'), ('2'), ('3'), ('4')) s(sample) LEFT JOIN (SELECT locus_key, sample, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a FROM items GROUP BY ALL) c ON c.locus_key = r.locus_key AND c.sample = s.sample)""",
    "marks": """marks AS (SELECT *, CASE WHEN g IS NOT NULL THEN 1 ELSE 0 END AS called, CASE WHEN g IS NULL THEN 1 ELSE 0 END AS missing, CASE WHEN g = '01' THEN 1 ELSE 0 END AS het, CASE WHEN g IN ('01', '11') THEN 1 ELSE 0 END AS nonref,
      CASE WHEN g IS NOT NULL AND gts_n >= 2 AND same = min(CASE WHEN g IS NOT NULL THEN same END) OVER (PARTITION BY contig, i) THEN 1 ELSE 0 END AS minor_gt,
      CASE WHEN g IN ('01', '11') AND (carry <= 1 OR carry / 5 <= 0.05) THEN 1 ELSE 0 END AS rare, CASE WHEN g IN ('01', '11') AND ((role = 'target' AND carry_o = 0) OR (role = 'off_target' AND carry_t = 0)) THEN 1 ELSE 0 END AS private, CASE WHEN g IS NOT NULL AND called_all > 2 THEN same / called_all END AS call_freq
      FROM (SELECT *, count(g) OVER (PARTITION BY contig, i, g) AS same, count(g) OVER (PARTITION BY contig, i) AS called_all, (SELECT 1) AS one,
        (CASE WHEN bool_or(g = '00') OVER (PARTITION BY contig, i) THEN 1 ELSE 0 END + CASE WHEN bool_or(g = '01') OVER (PARTITION BY contig, i) THEN 1 ELSE 0 END + CASE WHEN bool_or(g = '11') OVER (PARTITION BY contig, i) THEN 1 ELSE 0 END) AS gts_n,
        count(*) FILTER (WHERE g IN ('01', '11')) OVER (PARTITION BY contig, i) AS carry, count(*) FILTER (WHERE g IN ('01', '11') AND role = 'target') OVER (PARTITION BY contig, i) AS carry_t, count(*) FILTER (WHERE g IN ('01', '11') AND role = 'off_target') OVER (PARTITION BY contig, i) AS carry_o FROM gts))""",
    "wins": """wins AS (SELECT contig, CAST(k AS INTEGER) AS w, k * 10 AS lo, k * 10 + 20 AS hi FROM (SELECT contig, unnest(range(CASE WHEN n <= 20 THEN 1 ELSE CAST(ceil((n - 20) / 10) AS BIGINT) + 1 END)) AS k FROM (SELECT DISTINCT contig, n FROM records)))""",
    "pairs": """pairs AS (SELECT w.contig, w.w, a.sample AS sample_a, b.sample AS sample_b, CAST(count(*) AS BIGINT) AS compared, CAST(count(*) FILTER (WHERE a.g = b.g) AS BIGINT) AS matches, count(*) FILTER (WHERE a.g = b.g) / count(*) AS similarity
      FROM wins w JOIN gts a ON a.contig = w.contig AND a.i >= w.lo AND a.i < w.hi JOIN gts b ON b.contig = a.contig AND b.i = a.i AND a.sample < b.sample WHERE a.g IS NOT NULL AND b.g IS NOT NULL GROUP BY ALL)""",
    "near": """near AS (SELECT contig, w, sample, other AS nearest, similarity AS nearest_similarity, compared AS nearest_compared FROM (SELECT *, row_number() OVER (PARTITION BY contig, w, sample ORDER BY similarity DESC, other) AS turn FROM
      (SELECT contig, w, sample_a AS sample, sample_b AS other, similarity, compared FROM pairs UNION ALL SELECT contig, w, sample_b, sample_a, similarity, compared FROM pairs)) WHERE turn = 1)""",
    "sw": """sw AS (SELECT w.contig, w.w, m.sample, m.role, CAST(sum(called) AS BIGINT) AS called_n, CAST(sum(missing) AS BIGINT) AS missing_n, CAST(sum(het) AS BIGINT) AS het_n, CAST(sum(nonref) AS BIGINT) AS nonref_n, CAST(sum(minor_gt) AS BIGINT) AS minor_genotype_n, CAST(sum(rare) AS BIGINT) AS rare_alt_n, CAST(sum(private) AS BIGINT) AS private_alt_n,
      count(*) AS n_variants, min(m.start) AS start, max(m."end") AS "end", CASE WHEN count(call_freq) > 3 THEN median(call_freq) END AS median_call_freq FROM wins w JOIN marks m ON m.contig = w.contig AND m.i >= w.lo AND m.i < w.hi GROUP BY ALL)""",
}
_NEEDS = {"calls": ["items"], "counts": ["calls"], "graded": ["counts"], "scored": ["graded", "loci"], "hits": ["scored"], "merged": ["hits"], "records": ["loci"], "gts": ["records", "items"], "marks": ["gts"], "wins": ["records"], "pairs": ["wins", "gts"], "near": ["pairs"], "sw": ["wins", "marks"]}


def with_sql(names: str, body: str) -> str:
    """``body`` behind the common table expressions that the named ones need, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(SQL[n] for n in order) + "\n" + body
