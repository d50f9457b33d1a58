"""Intervals: range joins, nearest matches and gaps-and-islands. Half-open, 0-based throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bin in the range join; rows that span many bins are repeated once per bin.
BIN = 16_384
#: Length of a stretch, over which a contig's ordered work is dealt out.
STRETCH = 1 << 18


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def reciprocal_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over the span of both; 0 if they don't meet."""
    both = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    span = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when((both > 0) & (span > 0), both / span).otherwise(F.lit(0.0))


def _binned(df: DataFrame, start: Column, end: Column, width: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(F.greatest(end - 1, start) / width).cast("long"))))


def range_join(a: DataFrame, b: DataFrame, width: int = BIN, tolerance: int = 0, how: str = "inner") -> DataFrame:
    """Pairs of rows on one contig whose intervals overlap, or come within ``tolerance``.

    ``a`` has a_contig, a_start, a_end and ``b`` b_contig, b_start, b_end. Both
    sides are repeated over the bins they touch and joined on (contig, bin), so
    a contig with most of the rows is spread over its bins; a pair is kept only
    in the bin where its overlap begins, which removes repeats without a
    shuffle. Catalyst has no range join: without bins the plan would compare all
    rows of a contig.
    """
    lo, hi = F.col("a_start") - tolerance, F.col("a_end") + tolerance + (1 if tolerance else 0)
    left = _binned(a, lo, hi, width, "_bin_a").withColumn("_lo", lo)
    right = _binned(b, F.col("b_start"), F.col("b_end"), width, "_bin_b")
    if tolerance:
        meet = (F.col("b_start") <= F.col("a_end") + tolerance) & (F.col("b_end") >= F.col("a_start") - tolerance)
        # a partner that only touches the widened interval from below ends at its first base
        right = _binned(b, F.col("b_start"), F.col("b_end") + 1, width, "_bin_b")
    else:
        meet = overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    first = F.floor(F.greatest(F.col("_lo"), F.col("b_start")) / width).cast("long") == F.col("_bin_a")
    on = (F.col("a_contig") == F.col("b_contig")) & (F.col("_bin_a") == F.col("_bin_b")) & first & meet
    return left.join(right, on, how).drop("_bin_a", "_bin_b", "_lo")


def matching(a: DataFrame, b: DataFrame, key: str, width: int = BIN) -> DataFrame:
    """Semi join: the rows of ``a`` (unique by ``key``) that overlap any row of ``b``."""
    return a.join(range_join(a, b, width).select(key).distinct(), key, "left_semi")


def best(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_turn", F.row_number().over(w)).filter("_turn = 1").drop("_turn")


def islands(df: DataFrame, keys: list[str], order: list, starts: Column, column: str = "island") -> DataFrame:
    """Numbers runs within ``keys``: a run begins where ``starts`` holds (it may use lag over the same order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.when(starts, 1).otherwise(0)).withColumn(column, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def stretched(df: DataFrame, position: str, width: int = STRETCH) -> DataFrame:
    """Adds ``_s``, the stretch of a key's line that a row lies on; stretches follow each other in the order of positions."""
    return df.withColumn("_s", F.floor(F.col(position) / width).cast("long"))


def carried(rows: DataFrame, keys: list[str], order: list[str], **values: tuple[Column, str]) -> DataFrame:
    """Adds, from the stretches of a key before a row's own, one value for each name: (aggregate over a stretch, how stretches combine).

    ``last`` takes the aggregate of the nearest stretch before (``next``: after),
    ``sum`` and ``max`` combine all before. Rows are dealt out by (keys, stretch), so a
    contig with most rows is spread over its stretches; only one row for
    each stretch is ordered within a key.
    """
    per = rows.groupBy(*keys, "_s").agg(*[agg.alias(name) for name, (agg, _) in values.items()])
    w = Window.partitionBy(*keys).orderBy("_s")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    how = {"last": lambda c: F.lag(c).over(w), "next": lambda c: F.lead(c).over(w), "sum": lambda c: F.sum(c).over(before), "max": lambda c: F.max(c).over(before), "total": lambda c: F.sum(c).over(Window.partitionBy(*keys))}
    return rows.join(per.select(*keys, "_s", *[how[kind](name).alias(name) for name, (_, kind) in values.items()]), [*keys, "_s"])


def _numbered_runs(rows: DataFrame, keys: list[str], order: list[str], new: Column, column: str) -> DataFrame:
    """Running number of runs within keys, from stretches: runs begun in earlier stretches and those begun in this one."""
    rows = rows.withColumn("_new", F.when(new, 1).otherwise(0))
    rows = carried(rows, keys, order, _before=(F.sum("_new"), "sum"))
    w = Window.partitionBy(*keys, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.sum("_new").over(w) + F.coalesce("_before", F.lit(0))).drop("_new", "_before")


def merge_loci(loci: DataFrame, distance: int = 0, same_type: bool = False, ordinal: str = "ord") -> DataFrame:
    """Adds ``island``: loci in (contig, start, ordinal) order belong together while the gap to the previous row's end is at most ``distance``.

    The previous row's end counts, not the furthest end so far, and a type
    change ends a run if ``same_type``.
    """
    keys, order = ["contig"], ["start", ordinal]
    rows = carried(stretched(loci, "start"), keys, order, _prev=(F.max_by(F.struct("end", "variant_type"), F.struct(*order)), "last"))
    w = Window.partitionBy("contig", "_s").orderBy(*order)
    rows = rows.withColumn("_prev", F.coalesce(F.lag(F.struct("end", "variant_type")).over(w), F.col("_prev")))
    new = F.col("_prev").isNull() | (F.col("start") - F.col("_prev.end") > distance)
    if same_type:
        new |= F.col("_prev.variant_type") != F.col("variant_type")
    return _numbered_runs(rows, keys, order, new, "island").drop("_prev", "_s")


def region_rollup(merged: DataFrame, ordinal: str = "ord") -> DataFrame:
    """One row per island: extent, number of loci, types, dominant class (ties: first seen), consistency and mean score."""
    keys = ["contig", "island"]
    by_class = merged.groupBy(*keys, "strictness_class").agg(F.count("*").alias("n"), F.min(F.struct("start", ordinal)).alias("first"))
    top = by_class.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "strictness_class")).alias("m")).select(*keys, F.col("m.strictness_class").alias("dominant_strictness_class"))
    sums = merged.groupBy(*keys).agg(
        F.min("start").alias("start"),
        F.max_by("end", F.struct("start", ordinal)).alias("end"),
        F.count("*").alias("n_loci"),
        F.array_join(F.sort_array(F.collect_set("variant_type")), ",").alias("variant_types"),
        (F.count_if(F.col("target_missing_n") == 0) / F.count("*")).alias("target_consistency"),
        (F.count_if(F.col("offtarget_support_n") == 0) / F.count("*")).alias("offtarget_exclusion"),
        F.avg("final_score").alias("final_score"),
    )
    return sums.join(top, keys)


def union_of_intervals(df: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Merged (keys, start, end): intervals that touch, or lie within ``gap``, become one; the furthest end so far counts."""
    order = ["start", "end"]
    rows = carried(stretched(df.select(*keys, "start", "end"), "start"), keys, order, _far=(F.max("end"), "max"))
    w = Window.partitionBy(*keys, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_reach", F.greatest("_far", F.max("end").over(w)))  # greatest skips nulls
    runs = _numbered_runs(rows, keys, order, F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap), "island")
    return runs.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def gaps_between(merged: DataFrame, keys: list[str], closed: bool = False) -> DataFrame:
    """What lies between consecutive merged intervals: introns between exons."""
    step = 1 if closed else 0
    rows = carried(stretched(merged, "start"), keys, ["start"], _later=(F.min("start"), "next"))
    w = Window.partitionBy(*keys, "_s").orderBy("start")
    rows = rows.withColumn("_next", F.coalesce(F.lead("start").over(w), F.col("_later")))
    return rows.select(*keys, (F.col("end") + step).alias("start"), (F.col("_next") - step).alias("end")).filter(F.col("end") >= F.col("start") if closed else F.col("end") > F.col("start"))


def consecutive_runs(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Adds ``island``: runs of consecutive positions, by position minus row number."""
    rows = carried(stretched(df, position), keys, [position], _before=(F.count("*"), "sum"))
    w = Window.partitionBy(*keys, "_s").orderBy(position)
    return rows.withColumn("island", F.col(position) - F.row_number().over(w) - F.coalesce("_before", F.lit(0))).drop("_s", "_before")


def nearest(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """For each row of ``left`` (a_ord, a_contig, a_start, a_end) the nearest of ``right`` (b_contig, b_start, b_end, ``name``) on its contig, however far.

    The distance is that of closed 1-based intervals, 0 inside; ties go to the
    least (start, end, name). A row that overlaps nothing lies between the last
    interval that ended before it and the first that starts after it; both are
    running extremes over (contig, stretch), carried from stretch to stretch.
    """
    inside = range_join(left, right).select("a_ord", F.lit(0).cast("long").alias("distance"), "b_start", "b_end", name)
    key = ["contig"]
    place = lambda df, side, at: df.select(F.col(f"{side}_contig").alias("contig"), F.col(at).alias("at"))
    point = F.struct("b_start", "b_end", name)

    def side(events: DataFrame, value: Column, backward: bool) -> DataFrame:
        """The last value at or before each asker in (contig, at); ``events`` has at, kind (0 for values) and a_ord."""
        rows = events.withColumn("_s", F.floor(F.col("at") / STRETCH).cast("long")).withColumn("_v", value)
        best_of = F.max("_v")
        per = rows.groupBy(*key, "_s").agg(best_of.alias("_v"))
        w = Window.partitionBy(*key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.join(per.select(*key, "_s", F.max("_v").over(w).alias("_far")), [*key, "_s"])
        own = Window.partitionBy(*key, "_s").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("_hit", F.greatest("_far", F.max("_v").over(own))).filter("kind = 1")

    # what ended before: positions grow; what starts after: positions are mirrored, so that it is the same question
    lower = right.select(F.col("b_contig").alias("contig"), F.col("b_end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("a_ord"), "b_start", "b_end", name)
    ask = left.select(F.col("a_contig").alias("contig"), F.col("a_start").alias("at"), F.lit(1).alias("kind"), F.col("a_ord").cast("long").alias("a_ord"))
    before = side(lower.unionByName(ask, allowMissingColumns=True), F.when(F.col("kind") == 0, F.struct(F.col("at").alias("p"), (-F.col("b_start")).alias("s"), (-F.col("b_end")).alias("e"))), False)
    upper = right.select(F.col("b_contig").alias("contig"), (-F.col("b_start")).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("a_ord"), "b_start", "b_end", name)
    ask = left.select(F.col("a_contig").alias("contig"), (-F.col("a_end")).alias("at"), F.lit(1).alias("kind"), F.col("a_ord").cast("long").alias("a_ord"))
    after = side(upper.unionByName(ask, allowMissingColumns=True), F.when(F.col("kind") == 0, F.struct(F.col("at").alias("p"), (-F.col("b_end")).alias("e"))), True)
    names = right.groupBy("b_contig", "b_start", "b_end").agg(F.min(name).alias(name))
    found = before.select("a_ord", "contig", (-F.col("_hit.s")).alias("b_start"), (-F.col("_hit.e")).alias("b_end")).unionByName(after.select("a_ord", "contig", (-F.col("_hit.p")).alias("b_start"), (-F.col("_hit.e")).alias("b_end"))).filter("b_start is not null")
    found = found.join(names, (F.col("contig") == F.col("b_contig")) & found["b_start"].eqNullSafe(names["b_start"]) & found["b_end"].eqNullSafe(names["b_end"])).select("a_ord", found["b_start"], found["b_end"], name)
    own = left.select("a_ord", "a_start", "a_end")
    gap = F.greatest(F.lit(0), F.col("b_start") - (F.col("a_end") - 1), F.col("a_start") - (F.col("b_end") - 1))
    outside = found.join(own, "a_ord").select("a_ord", gap.cast("long").alias("distance"), "b_start", "b_end", name)
    every = inside.unionByName(outside)
    first = every.groupBy("a_ord").agg(F.min(F.struct("distance", "b_start", "b_end", name)).alias("m"))
    return first.select("a_ord", f"m.{name}", "m.distance")
