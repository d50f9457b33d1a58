"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.llm.common import written


def _to_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with, beside it, the least of u and all its v. An aggregate and a join: a hub's rows can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    ``edges`` has long columns u and v; loops and repeats are allowed. Each
    round's edges are written to the shared folder, so neither links nor
    components pass through the driver and lineage stays short; only a count
    and a checksum come back. An empty table gives an empty table.
    """
    own = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now, mark = None, None
    while True:
        source = own if now is None else now
        both = source.unionByName(source.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct(), "star")
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row["n"], row["x"]) == mark:
            break
        mark = (row["n"], row["x"])
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(heads)
