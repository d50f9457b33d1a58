"""Hopping windows over records or base pairs, as bridges from rows to window numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladespark.operators.intervals import STRETCH, carried, stretched


def record_index(df: DataFrame, keys: list[str], order: str, width: int = STRETCH) -> DataFrame:
    """Adds i, the 0-based number of each row within its keys by ``order`` (a number), and n, the number of rows.

    Rows are numbered within stretches of ``order`` and the counts of the stretches
    before are added, so a contig isn't one task.
    """
    rows = stretched(df, order, width)
    rows = carried(rows, keys, [order], _before=(F.count("*"), "sum"), n=(F.count("*"), "total"))
    w = Window.partitionBy(*keys, "_s").orderBy(order)
    return rows.withColumn("i", F.row_number().over(w) - 1 + F.coalesce("_before", F.lit(0))).drop("_s", "_before")


def window_range(size: int, step: int, i: str = "i", n: str = "n") -> tuple:
    """Lowest and highest window of row i of n: windows start every ``step`` rows and the first that reaches the last row is the last."""
    i_, n_ = F.col(i), F.col(n)
    last = F.when(n_ <= size, F.lit(0)).otherwise(F.ceil((n_ - size) / step)).cast("int")
    low = F.when(i_ < size, F.lit(0)).otherwise(F.floor((i_ - size + step) / step)).cast("int")
    high = F.least(F.floor(i_ / step).cast("int"), last)
    return low, high, last


def record_windows(df: DataFrame, size: int, step: int) -> DataFrame:
    """One row for each (row, window) with ``w``; rows in gaps between windows (step > size) vanish."""
    low, high, _ = window_range(size, step)
    rows = df.withColumns({"_lo": low, "_hi": high}).filter("_lo <= _hi")
    rows = rows.withColumn("w", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    inside = (F.col("w") * step <= F.col("i")) & (F.col("i") < F.col("w") * step + size) & (F.col("w") * step < F.col("n"))
    return rows.filter(inside)


def pane_windows(panes: DataFrame, size: int, step: int) -> DataFrame:
    """From panes of ``step`` rows (``pane``, with the contig's ``n``) to the windows made of size/step panes each.

    Sums over overlapping windows are made from panes, so rows are aggregated
    once instead of once per window.
    """
    k = size // step
    last = F.when(F.col("n") <= size, F.lit(0)).otherwise(F.ceil((F.col("n") - size) / step)).cast("int")
    low = F.greatest(F.col("pane") - (k - 1), F.lit(0))
    rows = panes.withColumns({"_lo": low.cast("int"), "_hi": F.least(F.col("pane").cast("int"), last)}).filter("_lo <= _hi")
    return rows.withColumn("w", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def bp_windows(df: DataFrame, size: int, step: int, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """One row for each (row, window it overlaps) on a grid anchored at the least start; only windows with rows are numbered (``w``).

    The first window that reaches the greatest end is the last.
    """
    base = df.groupBy(*keys).agg(F.min("start").alias("_base"), F.max("end").alias("_far"))
    rows = df.join(base, list(keys))
    last = F.greatest(F.ceil((F.col("_far") - F.col("_base") - size) / step).cast("long"), F.lit(0))
    low = F.greatest(F.floor((F.col("start") - F.col("_base") - size) / step).cast("long") + 1, F.lit(0))
    high = F.least(F.floor((F.col("end") - 1 - F.col("_base")) / step).cast("long"), last)
    rows = rows.withColumns({"_lo": low, "_hi": high}).filter("_lo <= _hi").withColumn("_grid", F.explode(F.sequence("_lo", "_hi")))
    at = F.col("_base") + F.col("_grid") * step
    rows = rows.filter((F.col("start") < at + size) & (F.col("end") > at))
    # grid numbers are few against rows: number them apart, then join
    numbers = rows.select(*keys, "_grid").distinct().withColumn("w", F.row_number().over(Window.partitionBy(*keys).orderBy("_grid")) - 1)
    return rows.join(numbers, [*keys, "_grid"]).drop("_base", "_far", "_lo", "_hi", "_grid")
