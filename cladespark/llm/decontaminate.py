"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Plain Jaccard LSH can't find a short item inside a long document, because the
document's size drowns the item's share. Items are therefore partitioned by
shingle count, and each is represented by its bottom-K MinHash shingles: if a
document contains a share t of an item, each of those K shingles is in the
document with chance t whatever the document's size. K and the number of hits
asked for follow from the size partition, the threshold and the target recall
(items of up to K shingles are probed whole, and then the count is exact).
Pairs with enough hits are verified on the item's whole shingle set.

Everything is DataFrame expressions. Documents' shingles meet the probes in an
equi join; probes and candidates are stored tables, so the planner knows their
size and broadcasts them only below its threshold, else both sides are dealt
out by shingle.

Items of one to four words are size classes of their own: such an item is one
shingle of all its words, and documents are also cut into n-grams of just the short
lengths that occur among the items, so it is found wherever its words stand next to
each other in a document of any length.

Defined cases: words are lower-cased runs of letters and digits; null or wordless items and documents match
nothing; repeated document rows give repeated pairs, repeated items pairs of
their own; null ids stay null; empty tables give empty tables; further columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladespark.llm.common import NULL_ID, doc_key, free_names, real_id, written

WORDS, PROBES = 5, 16


def shingles(text: str, words: int = WORDS, also: tuple[int, ...] = ()) -> Column:
    """Distinct 64-bit hashes of a text column's word n-grams; a shorter text has one for all its words.

    ``also``: further lengths below ``words`` whose n-grams are added.
    """
    split = f"filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"
    grams = f"transform(sequence(1, greatest(size(w) - {words - 1}, 1)), i -> xxhash64(slice(w, i, {words})))"
    for n in also:
        grams = f"concat({grams}, if(size(w) < {n}, array(), transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> xxhash64(slice(w, i, {n})))))"
    return F.expr(f"flatten(transform(array({split}), w -> if(size(w) = 0, array(), array_distinct({grams}))))")


def short_widths(text: str, words: int = WORDS) -> Column:
    """How many words a text has if it has fewer than ``words``, else null."""
    n = F.expr(f"size(filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> ''))")
    return F.when((n > 0) & (n < words), n)


def hits_needed(n: int, threshold: float, recall: float, probes: int = PROBES) -> int:
    """The most hits that an item of n shingles, contained with share ``threshold``, reaches with the target recall."""
    if n <= probes:
        return max(1, math.ceil(threshold * n - 1e-9))
    inside = math.ceil(threshold * n - 1e-9)
    total = math.comb(n, probes)
    missed = 0.0
    for hits in range(probes + 1):
        missed += math.comb(inside, hits) * math.comb(n - inside, probes - hits) / total
        if missed > 1 - recall:
            return max(1, hits)
    return probes


def size_partition(n: Column, threshold: float, recall: float, probes: int = PROBES) -> Column:
    """Hits needed by an item of n shingles: exact up to ``probes``, then by doubling size classes, of which the least demanding size counts."""
    rule = F.lit(1)
    for k in range(6, -1, -1):
        low, high = probes * 2**k, probes * 2 ** (k + 1)
        need = min(hits_needed(m, threshold, recall, probes) for m in range(low + 1, high + 1))
        rule = F.when((n > low) & (n <= high), F.lit(need)).otherwise(rule)
    return F.when(n <= probes, F.ceil(n * threshold - 1e-9).cast("int")).otherwise(rule)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, row, item_id, n_shingles, n_shared, containment): documents that contain at least ``threshold`` of an item's shingles."""
    bench = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("item_text"))
    bench = bench.select("item_id", F.xxhash64(F.col("item_text")).alias("item_row"), shingles("item_text").alias("sh"), short_widths("item_text").alias("width")).filter(F.size("sh") > 0)
    bench = bench.dropDuplicates(["item_id", "item_row"])
    bench = written(bench.select(doc_key("item_id").alias("item"), "item_row", "sh", F.size("sh").alias("n"), "width"), "items")
    # the size classes below a whole shingle: at most WORDS - 1 numbers
    also = tuple(sorted(r["width"] for r in bench.filter("width is not null").select("width").distinct().collect()))
    bench = bench.drop("width")
    bottom = F.expr(f"slice(array_sort(transform(sh, x -> struct(xxhash64(7L, x) as h, x as x))), 1, {PROBES})")
    probes = bench.select("item", "item_row", size_partition(F.col("n"), threshold, recall).alias("need"), F.explode(bottom).alias("p"))
    probes = written(probes.select("item", "item_row", "need", F.col("p.x").alias("x")), "probes")

    texts = docs.select(doc_key(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("doc_text")).filter("doc_text is not null")
    seen = texts.select("doc", "row", F.explode(shingles("doc_text", also=also)).alias("x"))
    # a document's shingles are distinct and so are an item's probes: matches are counted, not collected
    found = seen.join(probes, "x").groupBy("doc", "row", "item", "item_row", "need").agg(F.countDistinct("x").alias("hits")).filter("hits >= need")
    listed = written(found.groupBy("doc", "row").agg(F.collect_list(F.struct("item", "item_row")).alias("found")), "candidates")

    exact = texts.join(listed, ["doc", "row"]).select("doc", "row", shingles("doc_text", also=also).alias("doc_sh"), "found")
    exact = exact.select("doc", "row", "doc_sh", F.inline("found")).join(bench, ["item", "item_row"])
    exact = exact.select("doc", "row", real_id("item").alias("item_id"), F.col("n").cast("long").alias("n_shingles"), F.size(F.array_intersect("sh", "doc_sh")).cast("long").alias("n_shared"))
    exact = exact.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return exact.filter(F.col("n_shared") >= F.ceil(F.col("n_shingles") * threshold - 1e-9))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that contain a benchmark item."""
    k_doc, k_row, c_doc, c_row = free_names(docs, "k_doc", "k_row", "c_doc", "c_row")
    bad = written(contained_items(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("doc").alias(c_doc), F.col("row").alias(c_row)).distinct(), "contaminated")
    rows = docs.withColumns({k_doc: doc_key(id_col), k_row: F.xxhash64(F.col(text_col))})
    return rows.join(bad, (F.col(k_doc) == F.col(c_doc)) & (F.col(k_row) == F.col(c_row)), "left_anti").drop(k_doc, k_row)


__all__ = ["NULL_ID", "contained_items", "drop_contaminated", "hits_needed", "shingles", "size_partition"]
