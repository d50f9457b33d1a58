"""Dense tables: groups that the data lack get zero rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense(df: DataFrame, values: dict[str, list], fill: dict) -> DataFrame:
    """Left-join ``df`` to the product of small literal lists, filling counts."""
    frame = None
    for column, items in values.items():
        kind = df.schema[column].dataType
        one = df.sparkSession.createDataFrame([(v,) for v in items], f"{column} {kind.simpleString()}")
        frame = one if frame is None else frame.crossJoin(one)  # products of literals, a handful of rows
    return frame.join(df, list(values), "left").na.fill(fill)
