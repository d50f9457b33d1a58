"""Pairs inside large buckets: tasks of bounded size, and links proved without a comparison.

Both similarity joins put their representatives into buckets (a node of a trie, a
compound of strips). A bucket of up to ``block`` members is one task. For larger ones
a centre is made, the consensus of a few members (it need not be a member itself),
and every member's distance to it is measured exactly. Distances obey the triangle
inequality, so two members whose distances to one centre add up to no more than the
threshold are linked: their pairs are counted from a histogram of distances and never
met. Members within half the threshold of the centre (the inner ones) are therefore
all linked among themselves, and only the others (the outer ones) meet everybody:
with o outer members of n, a bucket gives about n * ceil(o / block) rows instead of
n * n / block. Which members a centre is made of changes what is proved, never the result.

Distances are kept as whole numbers of ``UNITS`` to the threshold, rounded up, so
rounding can only send a pair to the exact comparison.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladespark.llm.common import written

#: Steps in which a distance is measured: this many reach the link threshold.
UNITS, SALTS = 200, 32
#: Members that a centre is made of, and how often buckets that share members agree on the largest among them.
VOTERS, ROUNDS = 64, 3
NONE = "rep long, leader long, near int, copies long"


def centres(rows: DataFrame, payload: DataFrame, distances: Callable, consensus: Callable, block: int) -> DataFrame | None:
    """(rep, leader, near, copies): distance in units of each member of a large bucket to its centre, at most ``UNITS``; None without large buckets.

    ``rows`` has tree, node, rep; ``payload`` rep, copies and one column more.
    ``distances`` is a mapInArrow function from (rep, leader, copies, payload,
    centre) to (rep, leader, near, copies), ``consensus`` makes one payload of many.
    """
    sizes = written(rows.groupBy("tree", "node").agg(F.count("*").alias("n")).filter(F.col("n") > block), "large")
    if sizes.isEmpty():
        return None
    large = written(rows.join(sizes, ["tree", "node"]).select("rep", F.xxhash64("tree", "node").alias("at"), "n"), "members")
    # buckets of one group share members: each member, and through it each bucket, takes the largest bucket in reach
    best = large.select("rep", "at", F.struct("n", F.col("at").alias("top")).alias("best"))
    for _ in range(ROUNDS):
        own = written(best.groupBy("rep").agg(F.max("best").alias("best")), "own")
        node = large.select("rep", "at").join(own, "rep").groupBy("at").agg(F.max("best").alias("best"))
        best = large.select("rep", "at").join(written(node, "top"), "at")
    own = written(best.groupBy("rep").agg(F.max("best").alias("best")).select("rep", F.col("best.top").alias("leader")), "leaders")
    body = next(c for c in payload.columns if c not in ("rep", "copies"))
    # voters: the least of each of VOTERS parts of a centre's members
    voters = large.join(own.select("leader").distinct(), F.col("at") == F.col("leader")).withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(VOTERS)))
    voters = voters.groupBy("leader", "part").agg(F.min("rep").alias("rep")).drop("part").join(payload.select("rep", body), "rep")
    heads = written(voters.select("leader", F.col(body)).groupBy("leader").applyInArrow(consensus, "leader long, centre binary"), "consensus")
    # a centre may have a third of all rows: it is dealt out under several salts
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = own.join(payload, "rep").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(heads, ["leader", "salt"])
    found = pairs.select("rep", "leader", "copies", body, "centre").mapInArrow(distances, NONE)
    return written(found.filter(F.col("near") <= UNITS), "centres")


def proved_edges(middle: DataFrame) -> DataFrame:
    """(u, v): each member and the one nearest to its centre, where the two are proved to be linked."""
    first = middle.groupBy("leader").agg(F.min(F.struct("near", "rep")).alias("m")).select("leader", F.col("m.rep").alias("v"), F.col("m.near").alias("least"))
    return middle.join(first, "leader").filter(F.col("near") + F.col("least") <= UNITS).select(F.col("rep").alias("u"), "v")


def proved(middle: DataFrame) -> DataFrame:
    """(rep, links): documents linked to each member by the triangle inequality alone, without its own copies."""
    bins = middle.groupBy("leader", "near").agg(F.sum("copies").alias("c"))
    steps = bins.select("leader").distinct().withColumn("near", F.explode(F.sequence(F.lit(0), F.lit(UNITS))))
    upto = Window.partitionBy("leader").orderBy("near")  # UNITS + 1 rows for a leader
    total = steps.join(bins, ["leader", "near"], "left").select("leader", (F.lit(UNITS) - F.col("near")).alias("near"), F.sum(F.coalesce("c", F.lit(0))).over(upto).alias("c"))
    own = F.when(2 * F.col("near") <= UNITS, F.col("copies")).otherwise(0)
    return middle.join(total, ["leader", "near"]).select("rep", (F.col("c") - own).alias("links"))


def tasks(rows: DataFrame, nodes: DataFrame, middle: DataFrame | None, block: int) -> DataFrame:
    """(rep, tree, node, lo, hi, blk, leader, near): the tasks that each representative takes part in.

    ``nodes`` are the (tree, node) to compare. A pair of a task is to be
    compared if both have blk lo = hi or their blks differ, unless it is proved.
    """
    if middle is None:
        members = rows.select("rep", "tree", "node", F.lit(None).cast("long").alias("leader"), F.lit(None).cast("int").alias("near"))
    else:
        members = rows.select("rep", "tree", "node").join(middle.select("rep", "leader", "near"), "rep", "left")
    # sizes come from partial sums, so a hot node's rows meet only in the join below, which can be split
    counts = members.groupBy("tree", "node", "leader").agg(F.count("*").alias("n"), F.count_if(2 * F.col("near") <= UNITS).alias("n_in"))
    most = F.struct((F.col("leader").isNotNull()).alias("has"), "n", "leader", "n_in")
    plan = counts.groupBy("tree", "node").agg(F.sum("n").alias("n"), F.max(most).alias("m")).join(nodes.select("tree", "node"), ["tree", "node"])
    n_in = F.when(F.col("n") > block, F.col("m.n_in")).otherwise(0)
    plan = plan.select("tree", "node", F.when(F.col("n") > block, F.col("m.leader")).alias("main"), F.ceil((F.col("n") - n_in) / block).cast("int").alias("p"), F.ceil(n_in / block).cast("int").alias("q"))
    plan = written(plan.filter("p > 0"), "task_plan")
    marked = members.join(plan, ["tree", "node"]).withColumn("inner", F.coalesce((F.col("leader") == F.col("main")) & (2 * F.col("near") <= UNITS), F.lit(False)))
    place = F.xxhash64(F.lit(2), "rep")
    marked = marked.withColumn("blk", F.when(F.col("inner"), F.col("p") + F.pmod(place, F.greatest("q", F.lit(1))).cast("int")).otherwise(F.pmod(place, F.greatest("p", F.lit(1))).cast("int")))
    last = F.when(F.col("inner"), F.col("p") - 1).otherwise(F.col("p") + F.col("q") - 1)
    marked = marked.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return marked.select("rep", "tree", "node", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "leader", "near")


def distinct_nodes(rows: DataFrame, fresh=None) -> DataFrame:
    """(tree, node): the nodes with two members or more, of nodes with the same members only that of the first tree.

    ``fresh``, an aggregate, says which nodes hold pairs not met before.
    """
    groups = rows.groupBy("tree", "node").agg(F.count("*").alias("n"), F.min("rep").alias("first"), F.max("rep").alias("last"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y"), (fresh if fresh is not None else F.lit(True)).alias("fresh"))
    groups = groups.filter("n > 1 and fresh")
    return groups.groupBy("n", "first", "last", "x", "y").agg(F.min(F.struct("tree", "node")).alias("g")).select("g.*")


def proved_mask(leader: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which pairs of a task are proved; members without a leader have near above ``UNITS``."""
    return (leader[:, None] == leader[None, :]) & (near[:, None] + near[None, :] <= UNITS)
