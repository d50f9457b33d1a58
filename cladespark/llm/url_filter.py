"""URL filters as a temporal list join.

A block list is a log of dated entries (a pattern is added or removed). Each
addition becomes a validity interval that ends at the next entry of the pattern
in its category, and
an as-of join evaluates every capture against the intervals that hold at its
fetch time. A pattern is a domain, which covers its subdomains, or a domain
with a path, which covers what lies below that path. A capture asks for all its
host suffixes and all path prefixes of its host, so the join is an equi join on
the pattern with the time as a residual: a host with a third of all captures
meets just the few intervals of its own keys, and Spark may split its rows.

DataFrame functions only. The list side is a stored table, which the planner
broadcasts below its size threshold and deals out by pattern above it. Only
matching captures are aggregated.

Defined cases: hosts compare in lower case without user, port and trailing dot, paths as
they are; blanks before a URL are skipped, a URL may begin with the two slashes, an IPv6
host keeps its brackets;
null or hostless URLs and null fetch times match nothing; entries with a null
pattern, date or action are ignored; a null category is one of its own; of
entries for one pattern and category at the same time a removal wins and repeats
count once; repeated captures give repeated
rows; an empty list blocks nothing; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladespark.llm.common import written


#: What may stand before the host: blanks and control characters, and a scheme, which may be missing before the slashes.
_BEFORE = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL (an IPv6 address with its brackets), '' if it has none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _BEFORE + r"(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.regexp_replace(host, r"\.+$", "")


def path_of(url: Column) -> Column:
    """The path of a URL without slashes at its end, query and fragment."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), _BEFORE + r"[^/?#]*(/[^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def keys_of(host: str, path: str) -> Column:
    """All patterns that cover a URL: suffixes of its host, and its host with each prefix of its path."""
    return F.expr(f"""
        if({host} = '', cast(array() as array<string>), concat(
            transform(sequence(1, size(split({host}, '[.]'))), i -> array_join(slice(split({host}, '[.]'), i, 1000), '.')),
            filter(transform(sequence(1, size(split({path}, '/'))), i -> if(i = 1, '', concat({host}, array_join(slice(split({path}, '/'), 1, i), '/')))), k -> k <> '')))""")


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to): when each added entry holds; ``valid_to`` is null while it still does.

    ``entries`` has pattern, listed_at, action ('add' or 'remove') and category.
    """
    rows = entries.select(F.regexp_replace(F.concat(F.lower(F.substring_index("pattern", "/", 1)), F.regexp_replace("pattern", "^[^/]*", "")), "/+$", "").alias("pattern"), F.col("listed_at").cast("timestamp").alias("at"), "action", "category")
    rows = rows.filter("pattern is not null and at is not null and action in ('add', 'remove')").distinct()
    later = Window.partitionBy("pattern", "category").orderBy(F.unix_micros("at")).rangeBetween(1, Window.unboundedFollowing)
    removed = F.max((F.col("action") == "remove").cast("int")).over(Window.partitionBy("pattern", "category", "at"))
    rows = rows.withColumns({"valid_to": F.min("at").over(later), "gone": removed})
    return rows.filter("action = 'add' and gone = 0").select("pattern", "category", F.col("at").alias("valid_from"), "valid_to")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id, url, fetched_at, host, blocked, n_entries, categories): the entries active for each capture when it was fetched."""
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("at")).withColumn("host", host_of(F.col("url")))
    listed = written(intervals(entries), "intervals")
    keyed = rows.select("id", "url", "at", "host", path_of(F.col("url")).alias("path")).filter("host <> '' and at is not null").dropDuplicates(["id", "url", "at"])
    keyed = keyed.select("id", "url", "at", F.explode(F.array_distinct(keys_of("host", "path"))).alias("key"))
    active = keyed.join(listed, (F.col("key") == F.col("pattern")) & (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    found = active.groupBy(F.col("id").alias("m_id"), F.col("url").alias("m_url"), F.col("at").alias("m_at")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("c"))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("url") == F.col("m_url")) & (F.col("at") == F.col("m_at")), "left")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(time_col), "host", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("c", F.lit("")).alias("categories"))
