"""One query for each training-data operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladespark.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT a.*, (s.k IS NOT NULL AND a.doc_id <> s.top) AS gone FROM keyed a LEFT JOIN shared s ON a.k = s.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladespark.llm.bpe import encode

    out = encode(table(spark, sf_dir, "documents"), word_bpe_path(), round_trip=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladespark.llm.common import real_id
    from cladespark.llm.ngram_jaccard import ngram_jaccard

    out = ngram_jaccard(table(spark, sf_dir, "documents"))
    return out.select(real_id("doc").alias("doc_id"), "class_id", "n_links", "group_id", (F.col("doc") == F.coalesce("group_id", "doc")).alias("kept"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y, k = sx.n AND k = sy.n AS same FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE k * 5 >= (sx.n + sy.n - k) * 4
  UNION ALL SELECT a.doc_id, b.doc_id, true FROM words a JOIN words b ON len(a.w) = 0 AND len(b.w) = 0 AND a.doc_id <> b.doc_id),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
own AS (SELECT x, count(*) AS n, min(y) FILTER (WHERE same) AS c FROM links GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(c, doc_id)) AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(doc_id, coalesce(m, doc_id)) AS group_id, doc_id <= coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN own ON own.x = doc_id LEFT JOIN least ON least.x = doc_id
"""


#: Dated entries of a block list, as fixed values: pattern, date, action, category.
BLOCK_LIST = (
    ("casino-win.example.com", "2024-01-10", "add", "gambling"),
    ("casino-win.example.com", "2024-06-01", "remove", "gambling"),
    ("casino-win.example.com", "2024-09-15", "add", "gambling"),
    ("free-bets.example.com", "2024-03-05", "add", "gambling"),
    ("cheap-pills.example.com", "2024-02-01", "add", "pharmacy"),
    ("cheap-pills.example.com", "2024-08-20", "remove", "pharmacy"),
    ("example.net", "2024-11-01", "add", "zone"),
    ("example.net", "2024-11-15", "remove", "zone"),
    ("blog.tionsh.example.com/fr", "2024-04-01", "add", "section"),
    ("therhe.example.org/en", "2024-05-01", "add", "section"),
    ("therhe.example.org/en", "2024-07-01", "remove", "section"),
    ("tionble.example.org", "2024-10-10", "add", "spam"),
)


#: A page's host and path, as in ``url_filter`` but in one regular expression each that Spark and DuckDB both read.
_HOST = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"
_PATH = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)"
#: How entries follow from a pattern's number k (16 bits of its md5): action, days after its first day (k mod 200), condition, category.
_RULES = (
    ("add", "0", "k % 3 < 2", "'c' || k % 5"),
    ("remove", "20 + k % 40", "k % 2 = 0", "'c' || k % 5"),
    ("add", "90", "k % 4 = 0", "'c' || k % 5"),
    ("add", "10", "k % 7 = 0", "'other'"),
    ("remove", "60", "k % 14 = 0", "'other'"),
)


def block_list(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The entries above and thousands derived from the pages' own hosts and paths: additions, removals, re-additions, two categories."""
    from cladespark.llm.common import written

    entries = spark.createDataFrame(list(BLOCK_LIST), "pattern string, listed_at string, action string, category string")
    seen = pages.select(F.lower(F.regexp_extract("url", _HOST, 1)).alias("h"), F.regexp_replace(F.regexp_extract("url", _PATH, 1), "/+$", "").alias("p")).filter("h <> ''")
    names = seen.select("h").unionByName(seen.select(F.concat("h", F.regexp_extract("p", "^(/[^/]*)", 1)).alias("h"))).unionByName(seen.select(F.concat("h", "p").alias("h"))).distinct()
    numbered = names.select(F.col("h").alias("pattern"), F.expr("cast(conv(substring(md5(lower(h)), 1, 4), 16, 10) as int)").alias("k"))
    numbered = written(numbered, "patterns")  # one pass over the pages for all rules
    for action, after, when, category in _RULES:
        day = F.expr(f"cast(date_add(date'2024-01-01', k % 200 + {after}) as string)")
        entries = entries.unionByName(numbered.filter(when).select("pattern", day.alias("listed_at"), F.lit(action).alias("action"), F.expr(category).alias("category")))
    return entries


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture against the list above; pages carry no fetch time, so the day of the year follows the page id."""
    from cladespark.llm.url_filter import url_filter

    pages = table(spark, sf_dir, "pages")
    fetched = F.expr("timestamp_seconds(1704067200 + pmod(coalesce(page_id, 0), 366) * 86400)")
    out = url_filter(pages.select("page_id", "url", fetched.alias("fetched_at")), block_list(spark, pages.select("url")))
    return out.select("page_id", "url", F.expr("unix_seconds(fetched_at)").alias("fetched_s"), "host", "blocked", "n_entries", "categories")


OP4_SQL = (
    rf"""
WITH seen AS (
  SELECT page_id, url, CAST(1704067200 + (page_id % 366) * 86400 AS BIGINT) AS fetched_s, lower(regexp_extract(url, '{_HOST}', 1)) AS host,
         rtrim(regexp_extract(url, '{_PATH}', 1), '/') AS path FROM pages),
names AS (
  SELECT DISTINCT pattern, CAST('0x' || substr(md5(lower(pattern)), 1, 4) AS INTEGER) AS k
  FROM (SELECT host AS pattern FROM seen UNION ALL SELECT host || regexp_extract(path, '^(/[^/]*)', 1) FROM seen UNION ALL SELECT host || path FROM seen)
  WHERE pattern <> ''),
log(pattern, listed, action, category) AS (VALUES """
    + ", ".join(f"('{p}', DATE '{d}', '{a}', '{c}')" for p, d, a, c in BLOCK_LIST)
    + "".join(f"\n  UNION ALL SELECT rtrim(pattern, '/'), DATE '2024-01-01' + CAST(k % 200 + {after} AS INTEGER), '{action}', {category} FROM names WHERE {when}" for action, after, when, category in _RULES)
    + r"""),
entries AS (SELECT DISTINCT pattern, CAST(epoch(listed) AS BIGINT) AS at, action, category FROM log),
spans AS (
  SELECT pattern, category, a.at AS a, action = 'add' AND NOT EXISTS (
           SELECT 1 FROM entries r WHERE r.pattern = a.pattern AND r.category = a.category AND r.at = a.at AND r.action = 'remove') AS held,
         (SELECT min(n.at) FROM entries n WHERE n.pattern = a.pattern AND n.category = a.category AND n.at > a.at) AS b
  FROM entries a),
keys AS (
  SELECT DISTINCT host, path, unnest(list_concat(
           [array_to_string(string_split(host, '.')[i:], '.') for i in range(1, len(string_split(host, '.')) + 1)],
           [host || array_to_string(string_split(path, '/')[1:i], '/') for i in range(2, len(string_split(path, '/')) + 1)])) AS key
  FROM seen WHERE host <> '')
SELECT s.page_id, s.url, s.fetched_s, s.host, count(l.pattern) > 0 AS blocked,
       CAST(count(l.pattern) AS BIGINT) AS n_entries, coalesce(string_agg(DISTINCT l.category, ',' ORDER BY l.category), '') AS categories
FROM seen s LEFT JOIN keys k ON s.host = k.host AND s.path = k.path
LEFT JOIN spans l ON l.pattern = k.key AND l.held AND s.fetched_s >= l.a AND (l.b IS NULL OR s.fetched_s < l.b)
GROUP BY ALL
"""
)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladespark.llm.suffix_tree_lm import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladespark.llm.embedding_dedup import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                     WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT e.vec_id, CAST((SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS BIGINT) AS n_links,
       least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id <= coalesce(m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least ON least.x = e.vec_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladespark.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladespark.llm.html_extract import extract_pages

    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladespark.llm.common import real_id
    from cladespark.llm.decontaminate import contained_items

    out = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(real_id("doc").alias("doc_id"), "item_id", "n_shingles", "n_shared", "containment")


OP9_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
grams AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
  UNION
  SELECT 'd', id, array_to_string(w[i:i + n - 1], ' ')
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM words JOIN (SELECT DISTINCT len(w) AS n FROM words WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4) ON len(w) >= n WHERE kind = 'd')),
sizes AS (SELECT id, count(*) AS n FROM grams WHERE kind = 'i' GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS k
  FROM grams d JOIN grams i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(k AS BIGINT) AS n_shared, k / n AS containment
FROM shared JOIN sizes ON item_id = sizes.id WHERE k * 5 >= n * 4
"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cladespark.llm.quality import quality

    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("kept", F.col("quality") >= 0.5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op3_ngram_jaccard": OP3_SQL, "op4_url_filters": OP4_SQL, "op6_embedding_dedup": OP6_SQL, "op9_decontamination": OP9_SQL}
