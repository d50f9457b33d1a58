"""Windowed genotype landscapes: metrics per sample, pairwise similarity, nearest backgrounds and blocks.

The input is the long table ``calls``: contig, i (record number in the contig),
n (records of the contig), start, end, sample, role, gt (array of allele
numbers, null or with nulls if missing), one row per record and sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladespark.functions.rounding import fixed, half_even
from cladespark.operators.intervals import best, carried, islands, stretched
from cladespark.operators.kernel import numbered as _numbered
from cladespark.operators.windows import bp_windows, pane_windows, record_windows

SUMS = ("called_n", "missing_n", "het_n", "nonref_n", "minor_genotype_n", "rare_alt_n", "private_alt_n")
VARIANT_REASONS = ("no_alt", "filter", "qual", "multiallelic", "variant_type", "site_missing_rate", "no_active_alt", "min_alt_carriers", "min_alt_carrier_freq", "max_alt_carrier_freq")


def missing(gt: Column) -> Column:
    """Any missing allele makes a genotype missing."""
    return gt.isNull() | (F.size(gt) == 0) | F.exists(gt, lambda a: a.isNull())


def filter_reason(records: DataFrame, pass_only: bool = True, min_qual: float | None = None, variant_types: tuple[str, ...] | None = None, biallelic_only: bool = False, max_missing_rate: float | None = None, require_active_alt: bool = False, min_carriers: int | None = None, min_freq: float | None = None, max_freq: float | None = None) -> DataFrame:
    """Adds skip_reason (null: kept): the first rule that a record fails. ``records`` has alts, qual, filters and gts of the active samples."""
    called = F.filter("gts", lambda g: ~missing(g))
    carriers = F.size(F.filter(called, lambda g: F.exists(g, lambda a: a > 0)))
    n = F.size("gts")
    kind = lambda ref, alt: F.when(alt.startswith("<"), "sv").when((F.length(ref) == 1) & (F.length(alt) == 1), "snp").otherwise("indel")
    rules: list[tuple[Column, str]] = []
    rules.append((F.coalesce(F.size("alts"), F.lit(0)) < 1, "no_alt"))
    if pass_only:
        rules.append((~((F.size("filters") == 0) | F.array_contains("filters", "PASS")), "filter"))
    if min_qual is not None:  # here a missing QUAL fails
        rules.append((~F.coalesce(F.col("qual") >= min_qual, F.lit(False)), "qual"))
    if biallelic_only:
        rules.append((F.size("alts") != 1, "multiallelic"))
    if variant_types:
        rules.append((~F.exists("alts", lambda a: kind(F.col("ref"), a).isin(*variant_types)), "variant_type"))
    if max_missing_rate is not None:
        rules.append(((n - F.size(called)) / n > max_missing_rate, "site_missing_rate"))
    if require_active_alt:
        rules.append((carriers == 0, "no_active_alt"))
    for limit, test, name in ((min_carriers, carriers < F.lit(min_carriers), "min_alt_carriers"), (min_freq, carriers / n < F.lit(min_freq), "min_alt_carrier_freq"), (max_freq, carriers / n > F.lit(max_freq), "max_alt_carrier_freq")):
        if limit is not None:
            rules.append((test, name))
    reason = None
    for test, name in rules:
        reason = F.when(test, name) if reason is None else reason.when(test, name)
    return records.withColumn("skip_reason", reason)


def records_of(calls: DataFrame) -> DataFrame:
    """One row per record with ``x``, the array of (sample, role, gt) of its samples, from the long table."""
    rec = ["contig", "i", "n", "start", "end"]
    return calls.groupBy(*rec).agg(F.sort_array(F.collect_list(F.struct("sample", "role", "gt"))).alias("x"))


def _as_records(rows: DataFrame) -> DataFrame:
    return rows if "x" in rows.columns else records_of(rows)


def variant_marks(rows: DataFrame, rare_max_count: int = 1, rare_max_freq: float = 0.05, min_called_for_freq: int = 10) -> DataFrame:
    """Per record and sample: called, missing, het, nonref, minor genotype, rare and private counts and the call frequency.

    All of it follows from the record's own array ``x``, so records (as a VCF gives
    them) need no shuffle; a long table is gathered into records first.
    """
    g = "transform(x, s -> struct(s.sample as sample, s.role as role, if(s.gt is null or size(s.gt) = 0 or exists(s.gt, a -> a is null), null, array_sort(s.gt)) as g))"
    own = _as_records(rows).select("contig", "i", "n", "start", "end", F.expr(g).alias("x"))
    own = own.withColumn("_called", F.expr("transform(filter(x, s -> s.g is not null), s -> s.g)"))
    own = own.withColumn("_kinds", F.expr("transform(array_distinct(_called), k -> struct(k as g, size(filter(_called, c -> c = k)) as n))"))
    own = own.withColumn("_alts", F.expr("""transform(filter(array_distinct(flatten(_called)), a -> a > 0), a -> struct(a as a,
        size(filter(x, s -> array_contains(s.g, a))) as c, size(filter(x, s -> s.role = 'target' and array_contains(s.g, a))) as t, size(filter(x, s -> s.role = 'off_target' and array_contains(s.g, a))) as o))"""))
    own = own.withColumns({
        "_least": F.array_min(F.transform("_kinds", lambda k: k["n"])),
        "target_private": F.size(F.filter("_alts", lambda a: (a["t"] > 0) & (a["o"] == 0))).cast("long"),
        "offtarget_private": F.size(F.filter("_alts", lambda a: (a["o"] > 0) & (a["t"] == 0))).cast("long"),
    })
    own = own.select("contig", "i", "n", "start", "end", "_called", "_kinds", "_alts", "_least", "target_private", "offtarget_private", F.size("x").alias("_active"), F.inline("x"))
    has = F.col("g").isNotNull()
    same = F.element_at(F.filter("_kinds", lambda k: k["g"] == F.col("g")), 1)["n"]
    mine = F.filter("_alts", lambda a: F.array_contains("g", a["a"]))
    rare = lambda a: (a["c"] <= rare_max_count) | (a["c"] / F.col("_active") <= rare_max_freq)
    private = lambda a: ((F.col("role") == "target") & (a["t"] > 0) & (a["o"] == 0)) | ((F.col("role") == "off_target") & (a["o"] > 0) & (a["t"] == 0))
    number = lambda test: F.when(has, F.size(F.filter(mine, test))).otherwise(0).cast("long")
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    return own.select(
        "contig", "i", "n", "start", "end", "sample", "role", "g",
        one(has).alias("called_n"), one(~has).alias("missing_n"),
        one(has & (F.size(F.array_distinct("g")) > 1)).alias("het_n"), one(has & F.exists("g", lambda a: a > 0)).alias("nonref_n"),
        one(has & (F.size("_kinds") >= 2) & (F.when(has, same) == F.col("_least"))).alias("minor_genotype_n"),
        number(rare).alias("rare_alt_n"), number(private).alias("private_alt_n"),
        F.when(has & (F.size("_called") > min_called_for_freq), F.when(has, same) / F.size("_called")).alias("call_freq"),
        "target_private", "offtarget_private",
    )


def bp_bridge(rows: DataFrame, size: int, step: int) -> DataFrame:
    """(contig, i, w): the windows of base pairs that each record lies in."""
    one = (rows if "x" in rows.columns else rows.select("contig", "i", "start", "end").distinct()).select("contig", "i", "start", "end")
    return bp_windows(one, size, step).select("contig", "i", "w")


def _spread(rows: DataFrame, size: int, step: int, bridge: DataFrame | None) -> DataFrame:
    return record_windows(rows, size, step) if bridge is None else rows.join(bridge, ["contig", "i"])


def _bridged(rows: DataFrame, keys: list[str], sums: list[str], size: int, step: int, bridge: DataFrame | None = None) -> DataFrame:
    """Sums per (contig, w, keys); through panes where the step divides the size."""
    adds = [F.sum(c).alias(c) for c in sums]
    if bridge is None and size % step == 0:
        panes = rows.withColumn("pane", F.floor(F.col("i") / step)).groupBy("contig", "n", "pane", *keys).agg(*adds)
        return pane_windows(panes, size, step).groupBy("contig", "w", *keys).agg(*adds)
    return _spread(rows, size, step, bridge).groupBy("contig", "w", *keys).agg(*adds)


def window_extent(rows: DataFrame, size: int, step: int, bridge: DataFrame | None = None) -> DataFrame:
    """(contig, w, n_variants, start, end) and private events, from one row per record."""
    one = rows.select("contig", "i", "n", "start", "end", "target_private", "offtarget_private").distinct()
    if bridge is None and size % step == 0:
        panes = one.groupBy("contig", "n", F.floor(F.col("i") / step).alias("pane")).agg(F.count("*").alias("c"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("target_private").alias("target_private"), F.sum("offtarget_private").alias("offtarget_private"))
        wide = pane_windows(panes, size, step)
    else:
        wide = _spread(one.withColumn("c", F.lit(1)), size, step, bridge)
    return wide.groupBy("contig", "w").agg(F.sum("c").alias("n_variants"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("target_private").alias("target_private_alt_n"), F.sum("offtarget_private").alias("offtarget_private_alt_n"))


def sample_windows(marks: DataFrame, size: int, step: int, min_freq_values: int = 10, bridge: DataFrame | None = None) -> DataFrame:
    """Sums and rates per window and sample, with the median call frequency where there are enough values. ``bridge`` holds windows other than those of records."""
    sums = _bridged(marks, ["sample", "role"], list(SUMS), size, step, bridge)
    freqs = _spread(marks.filter("call_freq is not null").select("contig", "i", "n", "sample", "call_freq"), size, step, bridge)
    mid = freqs.groupBy("contig", "w", "sample").agg(F.count("*").alias("_k"), F.median("call_freq").alias("_m")).select("contig", "w", "sample", F.when(F.col("_k") > min_freq_values, F.col("_m")).alias("median_call_freq"))
    out = sums.join(window_extent(marks, size, step, bridge), ["contig", "w"]).join(mid, ["contig", "w", "sample"], "left")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns({"missing_rate": ratio("missing_n", "n_variants")} | {name: ratio(count, "called_n") for name, count in (("het_rate", "het_n"), ("nonref_rate", "nonref_n"), ("minor_genotype_rate", "minor_genotype_n"), ("rare_alt_rate", "rare_alt_n"), ("private_alt_rate", "private_alt_n"))})


def pair_similarity(rows: DataFrame, size: int, step: int, bridge: DataFrame | None = None) -> DataFrame:
    """(contig, w, sample_a, sample_b, compared, matches, similarity): genotypes equal among records called in both.

    The records of a pane (of a window, where the step doesn't divide the size) are
    one matrix of genotype codes; a product per code counts all pairs at once,
    so a row per pair is made for each pane and not for each record.
    """
    code = "transform(x, s -> struct(s.sample as sample, if(s.gt is null or size(s.gt) = 0 or exists(s.gt, a -> a is null), null, array_join(array_sort(s.gt), '/')) as g))"
    if "x" not in rows.columns and "g" in rows.columns:  # marks
        rows = rows.withColumn("gt", F.col("g"))
    own = _as_records(rows).select("contig", "i", "n", F.expr(code).alias("x"))
    own = own.select("contig", "i", "n", F.transform("x", lambda s: s["sample"]).alias("samples"), F.transform("x", lambda s: s["g"]).alias("codes"))
    whole = bridge is None and size % step == 0
    parts = own.withColumn("pane", F.floor(F.col("i") / step).cast("long")) if whole else _spread(own, size, step, bridge).withColumn("pane", F.col("w").cast("long"))
    ddl = "contig string, n long, pane long, sample_a string, sample_b string, compared long, matches long"
    panes = parts.select("contig", F.col("n").cast("long").alias("n"), "pane", "samples", "codes").groupBy("contig", "n", "pane").applyInPandas(_pair_counts, ddl)
    if whole:
        panes = pane_windows(panes, size, step)
    else:
        panes = panes.withColumn("w", F.col("pane").cast("int"))
    out = panes.groupBy("contig", "w", "sample_a", "sample_b").agg(F.sum("compared").alias("compared"), F.sum("matches").alias("matches"))
    return out.withColumn("similarity", F.col("matches") / F.col("compared"))


def _pair_counts(part: pd.DataFrame) -> pd.DataFrame:
    """Compared and equal genotypes of every pair of samples over the records of a pane."""
    names = sorted({s for row in part["samples"] for s in row})
    place = {s: k for k, s in enumerate(names)}
    codes: dict[str, int] = {}
    grid = np.full((len(part), len(names)), -1, np.int32)
    for r, (samples, row) in enumerate(zip(part["samples"], part["codes"])):
        for s, g in zip(samples, row):
            if g is not None:
                grid[r, place[s]] = codes.setdefault(g, len(codes))
    has = (grid >= 0).astype(np.float32)
    compared = has.T @ has
    matches = np.zeros_like(compared)
    for k in range(len(codes)):
        own = (grid == k).astype(np.float32)
        matches += own.T @ own
    a, b = np.triu_indices(len(names), 1)
    keep = compared[a, b] > 0
    a, b = a[keep], b[keep]
    label = np.array(names, dtype=object)
    return pd.DataFrame({"contig": part["contig"].iloc[0], "n": part["n"].iloc[0], "pane": part["pane"].iloc[0], "sample_a": label[a], "sample_b": label[b], "compared": compared[a, b].astype(np.int64), "matches": matches[a, b].astype(np.int64)})


def _both_ways(pairs: DataFrame) -> DataFrame:
    rest = [c for c in pairs.columns if c not in ("sample_a", "sample_b")]
    return pairs.select(F.col("sample_a").alias("sample"), F.col("sample_b").alias("other"), *rest).unionByName(pairs.select(F.col("sample_b").alias("sample"), F.col("sample_a").alias("other"), *rest))


def nearest_background(pairs: DataFrame, among: tuple[str, ...] | None = None) -> DataFrame:
    """The most similar other sample per window and sample; of equals the least name."""
    both = _both_ways(pairs)
    if among is not None:
        both = both.filter(F.col("other").isin(*among))
    return best(both, ["contig", "w", "sample"], F.col("similarity").desc(), "other").select("contig", "w", "sample", F.col("other").alias("nearest"), F.col("similarity").alias("nearest_similarity"), F.col("compared").alias("nearest_compared"))


def window_rows(samples: DataFrame, nearest: DataFrame) -> DataFrame:
    """One row per window: span, density, role means of the six-decimal rates and the most frequent nearest sample."""
    shown = lambda c: half_even(F.col(c), 6)
    mean = lambda c, role: F.avg(F.when(F.col("role") == role, shown(c)))
    keys = ["contig", "w", "n_variants", "start", "end", "target_private_alt_n", "offtarget_private_alt_n"]
    out = samples.groupBy(*keys).agg(mean("missing_rate", "target").alias("target_mean_missing_rate"), mean("missing_rate", "off_target").alias("offtarget_mean_missing_rate"), mean("nonref_rate", "target").alias("target_mean_nonref_rate"), mean("nonref_rate", "off_target").alias("offtarget_mean_nonref_rate"))
    # the first in sample order wins a tie
    often = nearest.groupBy("contig", "w", "nearest").agg(F.count("*").alias("k"), F.min("sample_ord").alias("first"))
    top = often.groupBy("contig", "w").agg(F.min(F.struct((-F.col("k")).alias("k"), "first", "nearest")).alias("m")).select("contig", "w", F.col("m.nearest").alias("top_nearest_background"), (-F.col("m.k")).alias("top_nearest_background_n"))
    span = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    return out.join(top, ["contig", "w"], "left").withColumns({"span_bp": span, "density_variants_per_kb": F.col("n_variants") / (span / 1000), "target_private_alt_rate": F.col("target_private_alt_n") / F.col("n_variants"), "offtarget_private_alt_rate": F.col("offtarget_private_alt_n") / F.col("n_variants")})


#: Counters of the filters in output order, with what they mean (fixed names).
FILTER_METRICS = (
    ("records_seen", "records read"), ("records_kept", "records that make windows"), ("skipped_no_alt", "records without ALT"), ("skipped_filter", "records that failed FILTER"), ("skipped_qual", "records below the QUAL threshold or without QUAL"),
    ("skipped_variant_type", "records of other variant types"), ("skipped_multiallelic", "records with more than one ALT"), ("skipped_site_missing_rate", "records with too many missing genotypes"), ("skipped_no_active_alt", "records no sample carries an ALT of"),
    ("skipped_min_alt_carriers", "records with too few carriers"), ("skipped_min_alt_carrier_freq", "records with too small a share of carriers"), ("skipped_max_alt_carrier_freq", "records with too large a share of carriers"), ("kept_fraction", "share of records kept"),
)


def filter_summary(marked: DataFrame) -> DataFrame:
    """(metric, value, description): the twelve counters and the share kept, in output order; one pass over the marked records."""
    counts = marked.agg(F.count("*").alias("records_seen"), F.count_if(F.col("skip_reason").isNull()).alias("records_kept"), *[F.count_if(F.col("skip_reason") == r).alias(f"skipped_{r}") for r in VARIANT_REASONS])
    share = F.when(F.col("records_seen") > 0, fixed(F.col("records_kept") / F.col("records_seen"), 6)).otherwise("NA")
    rows = [F.struct(F.lit(k).alias("n"), F.lit(name).alias("metric"), (share if name == "kept_fraction" else F.col(name).cast("string")).alias("value"), F.lit(text).alias("description")) for k, (name, text) in enumerate(FILTER_METRICS)]
    return counts.select(F.inline(F.array(*rows)))


def with_block_ids(blocks: DataFrame, prefix: str) -> DataFrame:
    """Blocks numbered from 1 by sample, contig and place: LB for backgrounds, IB for candidates of introgression."""
    return _numbered(blocks, "n", F.col("sample").asc(), F.col("contig").asc(), F.col("island").asc(), start=1).withColumn("block_id", F.format_string(f"{prefix}%08d", "n")).drop("n")


def with_window_ids(windows: DataFrame, contigs: dict[str, int] | None = None) -> DataFrame:
    """Windows numbered from 1, contigs in the file's order (else by name)."""
    place = F.create_map(*[F.lit(x) for pair in contigs.items() for x in pair])[F.col("contig")] if contigs else F.col("contig")
    rows = windows.withColumn("_place", place)
    return _numbered(rows, "n", F.col("_place").asc(), F.col("w").asc(), start=1).withColumn("window_id", F.format_string("LW%08d", "n")).drop("n", "_place")


def checked_parameters(**values) -> None:
    """ValueError for values out of range; names are those of the command's options."""
    def need(name: str, ok, text: str) -> None:
        value = values.get(name)
        if value is not None and not ok(value):
            raise ValueError(f"{name} {text}")

    for name in ("window_bp", "step_bp", "window_records", "step_records", "min_introgression_windows"):
        need(name, lambda v: v > 0, "must be positive")
    for name in ("min_alt_carriers", "rare_max_count", "min_called_for_freq", "min_freq_values"):
        need(name, lambda v: v >= 0, "must not be negative")
    for name in ("max_site_missing_rate", "min_alt_carrier_freq", "max_alt_carrier_freq", "rare_max_freq", "min_background_similarity", "min_introgression_similarity", "min_introgression_delta", "max_introgression_missing_rate"):
        need(name, lambda v: 0 <= v <= 1, "must be between 0 and 1")
    need("variant_type", lambda v: v in ("all", "snp", "indel", "sv"), "must be all, snp, indel or sv")
    low, high = values.get("min_alt_carrier_freq"), values.get("max_alt_carrier_freq")
    if low is not None and high is not None and low > high:
        raise ValueError("min_alt_carrier_freq must not exceed max_alt_carrier_freq")


def contig_runs(records: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(contig, runs): how many runs of consecutive records each contig has in the file; more than one means an unsorted file."""
    rows = carried(stretched(records.select("contig", "rec_ord").withColumn("_all", F.lit(0)), "rec_ord", width), ["_all"], ["rec_ord"], _prev=(F.max_by("contig", "rec_ord"), "last"))
    w = Window.partitionBy("_all", "_s").orderBy("rec_ord")
    new = ~F.coalesce(F.lag("contig").over(w), F.col("_prev")).eqNullSafe(F.col("contig"))
    return rows.withColumn("_new", new).groupBy("contig").agg(F.count_if("_new").alias("runs"))


def checked_runs(records: DataFrame) -> DataFrame:
    """``records``, or an error that names a contig whose records don't lie together."""
    bad = contig_runs(records).filter("runs > 1").orderBy("contig").limit(1).collect()
    if bad:
        raise ValueError(f"records of {bad[0]['contig']} don't lie together: sort the file")
    return records


def background_blocks(rows: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Runs, in window order, of one nearest sample per (sample, contig); below the threshold it is unassigned. Window gaps don't end a run."""
    ok = F.coalesce(half_even(F.col("nearest_similarity"), 6) >= threshold, F.lit(False))
    own = rows.withColumns({"_near": F.when(ok, F.col("nearest")).otherwise("unassigned"), "_role": F.when(ok, F.col("nearest_role")).otherwise("unassigned"), "_sim": F.when(ok, half_even(F.col("nearest_similarity"), 6))})
    keys, w = ["sample", "contig"], Window.partitionBy("sample", "contig").orderBy("w")
    own = own.withColumn("_last", F.lag(F.struct("_near", "_role")).over(w))
    runs = islands(own, keys, ["w"], F.col("_last").isNull() | (F.col("_last") != F.struct("_near", "_role")))
    return runs.groupBy(*keys, "island").agg(F.min("role").alias("cohort_role"), F.min_by("start", "w").alias("start"), F.max_by("end", "w").alias("end"), F.count("*").alias("n_windows"), F.min("_near").alias("nearest_background"), F.min("_role").alias("nearest_background_role"), F.avg("_sim").alias("mean_similarity"))


def introgression_blocks(rows: DataFrame, min_similarity: float = 0.65, min_delta: float = 0.05, max_missing: float = 0.5, min_windows: int = 10) -> DataFrame:
    """Runs of adjacent windows in which a target is closest to the same off-target sample, by enough and with little missing."""
    sim, lost = half_even(F.col("nearest_similarity"), 6), half_even(F.col("missing_rate"), 6)
    own = rows.filter((F.col("role") == "target") & (F.col("nearest_role") == "off_target") & (sim >= min_similarity) & (lost <= max_missing))
    own = own.withColumns({"_sim": sim, "_lost": lost, "_delta": sim - F.col("target_similarity")}).filter(F.col("_delta").isNull() | (F.col("_delta") >= min_delta))
    keys, w = ["sample", "contig"], Window.partitionBy("sample", "contig").orderBy("w")
    own = own.withColumns({"_donor": F.lag("nearest").over(w), "_at": F.lag("w").over(w)})
    runs = islands(own, keys, ["w"], F.col("_donor").isNull() | (F.col("_donor") != F.col("nearest")) | (F.col("_at") + 1 != F.col("w")))
    out = runs.groupBy(*keys, "island").agg(
        F.min_by("start", "w").alias("start"), F.max_by("end", "w").alias("end"), F.count("*").alias("n_windows"), F.min("nearest").alias("candidate_donor"), F.avg("_sim").alias("mean_donor_similarity"),
        F.avg("target_similarity").alias("mean_nearest_target_similarity"), F.avg("_delta").alias("mean_similarity_delta"), F.max("_lost").alias("max_missing_rate"), F.avg(half_even(F.col("private_alt_rate"), 6)).alias("mean_private_alt_rate"), F.avg(half_even(F.col("nonref_rate"), 6)).alias("mean_nonref_rate"),
    )
    kind = F.when(F.col("mean_similarity_delta").isNull(), "donor_like_single_target").when(F.col("mean_similarity_delta") > 0, "offtarget_closer_than_target").otherwise("candidate_introgression")
    return out.filter(F.col("n_windows") >= min_windows).withColumn("evidence_class", kind)


def similarity_summary(pairs: DataFrame, rounded: bool = True) -> DataFrame:
    """Means per pair over all windows; from six-decimal values where full rows are also written."""
    value = half_even(F.col("similarity"), 6) if rounded else F.col("similarity")
    return pairs.groupBy("sample_a", "sample_b").agg(F.count("*").alias("n_windows"), F.avg(value).alias("mean_similarity"), F.sum("compared").alias("compared_variants"))


def local_pca(pairs: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """Classical scaling of 1 - similarity per window: the two leading positive axes (signs are arbitrary) and their share of variance."""
    index = {s: k for k, s in enumerate(samples)}

    def scale(part: pd.DataFrame) -> pd.DataFrame:
        n = len(samples)
        d = np.ones((n, n))
        np.fill_diagonal(d, 0.0)
        a, b = part["sample_a"].map(index).to_numpy(), part["sample_b"].map(index).to_numpy()
        d[a, b] = d[b, a] = 1.0 - part["similarity"].to_numpy()
        center = np.eye(n) - 1.0 / n
        values, vectors = np.linalg.eigh(-0.5 * center @ (d**2) @ center)
        order = np.argsort(values)[::-1]
        order = order[values[order] > 1e-12]
        total = values[order].sum()
        axes = [(vectors[:, k] * np.sqrt(values[k]), values[k] / total) for k in order[:2]] + [(np.zeros(n), 0.0)] * 2
        compared = np.bincount(np.concatenate([a, b]), minlength=n)
        return pd.DataFrame({"contig": part["contig"].iloc[0], "w": part["w"].iloc[0], "sample": samples, "local_pc1": axes[0][0], "local_pc2": axes[1][0], "local_pc1_variance": axes[0][1], "local_pc2_variance": axes[1][1], "n_compared_samples": compared})

    return pairs.select("contig", "w", "sample_a", "sample_b", "similarity").groupBy("contig", "w").applyInPandas(scale, "contig string, w int, sample string, local_pc1 double, local_pc2 double, local_pc1_variance double, local_pc2_variance double, n_compared_samples long")
