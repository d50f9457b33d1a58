"""Rounding and number texts that equal those of correctly rounded half-even decimal rounding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Splits a double into two halves of 26 bits, so that products of halves are exact.
_SPLIT = 134217729.0


def half_even(value: Column, digits: int) -> Column:
    """A double rounded to ``digits`` decimals by its exact binary value, ties to even.

    ``round`` and ``bround`` go by the shortest decimal text instead, which
    differs for values such as 2.675. Here the error of value * 10^digits is
    computed exactly from split factors and settles apparent ties.
    """
    scale = float(10**digits)
    high = scale * _SPLIT - (scale * _SPLIT - scale)
    low = scale - high

    def rounded(x: Column) -> Column:
        p = x * scale
        x_high = x * _SPLIT - (x * _SPLIT - x)
        x_low = x - x_high
        error = ((x_high * high - p) + x_high * low + x_low * high) + x_low * low
        base = F.floor(p).cast("double")
        rest = p - base
        even = F.pmod(base, F.lit(2.0)) == 0
        up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & ~even)))
        # beyond 2^52 there are no decimals left to round
        return F.when(F.abs(p) < 2.0**52, F.when(up, base + 1).otherwise(base) / scale).otherwise(x)

    # a lambda binds the value once, else nested roundings would grow without bound
    return F.transform(F.array(value.cast("double")), rounded)[0]


def fixed(value: Column, digits: int) -> Column:
    """A double with a fixed number of decimals, 'NA' for null."""
    return F.when(value.isNull(), F.lit("NA")).otherwise(F.format_string(f"%.{digits}f", half_even(value, digits)))


@F.pandas_udf(StringType())
def general_6(value: pd.Series) -> pd.Series:
    """``%.6g`` texts: Spark's formatter has no %g that drops trailing zeros."""
    return value.map(lambda x: None if pd.isna(x) else f"{x:.6g}")


@F.pandas_udf(StringType())
def quoted(value: pd.Series) -> pd.Series:
    """URL quoting that leaves ``._:-`` as they are and writes a space as %20."""
    from urllib.parse import quote

    return value.map(lambda x: None if x is None else quote(x, safe="._:-"))
