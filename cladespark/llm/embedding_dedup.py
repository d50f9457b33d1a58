"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on ``TABLES * LINES`` random lines, in two uses.

Meeting: each line is cut into strips of ``STRIP``; the strips of ``LINES`` lines make a
compound key, and there are ``TABLES`` of them. Two vectors meet if they share a key.
On one line a pair at the threshold shares a strip with a known chance, so the
chance to meet in some table is known too (``meeting_recall``). A vector has ``TABLES``
keys whatever the number of vectors under its label.

Counting: vectors that meet are sorted by one line, so that what a vector can reach is
a range, and collisions in windows of ``WINDOW`` centred on it are counted over
``PROJECTIONS`` lines; small buckets, most of them, are counted many at a time. A pair at the threshold collides on a line with chance p; the
count that it must reach is the largest that keeps the target recall under a
binomial law with p. Pairs that reach it are verified with the exact cosine.

Equal vectors of a label are one class and count by their copies. Large buckets follow
``near_groups``: links that the triangle inequality of the angle proves are counted from
the distances to a centre; the others are compared in blocks, each pair of blocks a
task of bounded size that returns one row per vector (links and local component), never
one per pair. A pair is counted in the first table where it meets.

Defined cases: vectors of different labels never meet; a null label, and a
vector that is null, zero, or holds null or non-finite components links with
nothing; vectors of different lengths under one label don't link; equal vectors
link like others; rows that repeat a ``vec_id`` are rows of their own; a null
``vec_id`` sorts below all others; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.llm.common import doc_key, real_id, written
from cladespark.llm.components import connected_components
from cladespark.llm.near_groups import UNITS, centres, distinct_nodes, proved, proved_edges, tasks

TABLES, LINES, STRIP = 128, 20, 2.2
PROJECTIONS, WINDOW, BLOCK = 128, 0.35, 1024
#: Buckets of at most so many members are compared together, larger ones one by one.
SMALL, CHUNK = 24, 16_384


def _spread(threshold: float) -> float:
    """Deviation of the difference of two unit vectors' projections at the threshold."""
    return math.sqrt(max(2 - 2 * threshold, 1e-12))


def required_count(threshold: float, recall: float, m: int = PROJECTIONS, window: float = WINDOW) -> int:
    """The largest collision count that a pair at the threshold reaches with the target recall."""
    p = math.erf(window / _spread(threshold) / math.sqrt(2))
    missed = 0.0
    for count in range(m + 1):
        missed += math.comb(m, count) * p**count * (1 - p) ** (m - count)
        if missed > 1 - recall:
            return max(1, count)
    return m


def meeting_recall(threshold: float, tables: int = TABLES, n_lines: int = LINES, strip: float = STRIP) -> float:
    """Chance that a pair at the threshold shares a compound key of some table; strips start at a random place."""
    far, width = np.linspace(0, strip, 20_001, retstep=True)
    s = _spread(threshold)
    same = float(((1 - far / strip) * np.exp(-((far / s) ** 2) / 2)).sum() * width * 2 / s / math.sqrt(2 * math.pi))
    return 1 - (1 - min(same, 1.0) ** n_lines) ** tables


def lines(dim: int, m: int = TABLES * LINES) -> np.ndarray:
    """m random directions whose components have unit variance, so projections of unit vectors do too."""
    return np.random.default_rng(1000 + dim).standard_normal((dim, m))


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, copies, v, keys) of (rep, copies, label, emb): the vector and its 32-bit compound keys, one for each table."""
    drawn: dict[int, tuple] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            lists = part.column(3)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(ends)
            blobs, keys = [b""] * part.num_rows, [b""] * part.num_rows
            labels = part.column(2).to_numpy()
            for dim in np.unique(sizes).tolist():
                if dim not in drawn:
                    shift = np.random.default_rng(2000 + dim).uniform(0, STRIP, TABLES * LINES)
                    odd = np.random.default_rng(3000 + dim).integers(1, 2**63, (TABLES, LINES), dtype=np.uint64) | np.uint64(1)
                    drawn[dim] = lines(dim), shift, odd
                directions, shift, odd = drawn[dim]
                at = np.flatnonzero(sizes == dim)
                raw = [flat[ends[i] : ends[i + 1]] for i in at]
                strips = np.floor((_units(raw) @ directions + shift) / STRIP).astype(np.int64).astype(np.uint64)
                code = (strips.reshape(len(at), TABLES, LINES) * odd).sum(axis=2, dtype=np.uint64)
                code ^= labels[at].astype(np.uint64)[:, None] ^ np.uint64(dim)
                code = (code ^ (code >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                for i, v, k in zip(at.tolist(), raw, code):
                    blobs[i], keys[i] = np.ascontiguousarray(v).tobytes(), (k >> np.uint64(32)).astype(">u4").tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blobs, pa.binary()), pa.array(keys, pa.binary())], names=["rep", "copies", "v", "keys"])


def _consensus(kind: type):
    """The mean direction of vectors, as doubles; of one length, if keys that met by chance mix several."""

    def run(table: pa.Table) -> pa.Table:
        vectors = [np.frombuffer(x.as_py(), kind) for x in table["v"]]
        dim = max(len(v) for v in vectors)
        return pa.table({"leader": table["leader"].slice(0, 1), "centre": pa.array([_units([v for v in vectors if len(v) == dim]).sum(axis=0).tobytes()], pa.binary())})

    return run


def _distances(threshold: float, kind: type):
    """(rep, leader, near, copies) of (rep, leader, copies, v, centre): the angle, in units of the threshold's."""
    most = math.acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for own, head in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                a, b = np.frombuffer(own, kind).astype(np.float64), np.frombuffer(head, np.float64)
                if len(a) != len(b) or not b.any():  # keys of vectors that don't compare met by chance
                    near.append(UNITS + 1)
                    continue
                a, b = _units([a, b])
                angle = math.acos(min(1.0, max(-1.0, float(a @ b))))
                near.append(min(UNITS + 1, math.ceil(angle / most * UNITS + 1e-4)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), batch.column(2)], names=["rep", "leader", "near", "copies"])

    return run


class _Bucketed:
    """Rows of whole tasks, in task order: unit vectors, projections, keys, and what decides which pairs count."""

    def __init__(self, table: pa.Table, kind: type):
        vectors = [np.frombuffer(v, kind) for v in table["v"].to_pylist()]
        self.dim = np.array([len(v) for v in vectors])
        self.x = np.zeros((len(vectors), self.dim.max()))
        self.at = np.zeros((len(vectors), PROJECTIONS), np.float32)
        for dim in np.unique(self.dim).tolist():
            own = np.flatnonzero(self.dim == dim)
            unit = _units([vectors[i] for i in own])
            self.x[own, :dim] = unit
            self.at[own] = unit @ lines(dim)[:, :PROJECTIONS]
        self.keys = np.frombuffer(b"".join(table["keys"].to_pylist()), ">u4").astype(np.uint32).reshape(-1, TABLES)
        self.rep, self.copies, self.blk, self.tree, self.lo, self.hi = (table[c].to_numpy() for c in ("rep", "copies", "blk", "tree", "lo", "hi"))
        self.leader, self.near = table["leader"].fill_null(0).to_numpy(), table["near"].fill_null(UNITS + 1).to_numpy()

    def compared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs are this task's: of its two blocks, not proved, and met in no earlier table."""
        proved = (self.leader[i] == self.leader[j]) & (self.near[i] + self.near[j] <= UNITS)
        own = ((self.lo[i] == self.hi[i]) | (self.blk[i] != self.blk[j])) & ~proved & (self.rep[i] != self.rep[j]) & (self.dim[i] == self.dim[j])
        i, j = i[own], j[own]
        met = (self.keys[i] == self.keys[j]) & (np.arange(TABLES)[None, :] < self.tree[i][:, None])
        own[np.flatnonzero(own)[met.any(axis=1)]] = False
        return own

    def linked(self, i: np.ndarray, j: np.ndarray, threshold: float, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that collide on enough lines and reach the threshold."""
        own = self.compared(i, j)
        i, j = i[own], j[own]
        enough = (np.abs(self.at[i] - self.at[j]) <= WINDOW).sum(axis=1) >= count
        i, j = i[enough], j[enough]
        close = np.einsum("ij,ij->i", self.x[i], self.x[j]) >= threshold
        return i[close], j[close]


def _candidates(rows: _Bucketed, start: np.ndarray, size: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within tasks, in pieces of bounded size."""
    for m in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
        a, b = np.triu_indices(m, 1)
        first = start[size == m]
        step = max(1, CHUNK // len(a))
        for k in range(0, len(first), step):
            part = first[k : k + step, None]
            yield (part + a).ravel(), (part + b).ravel()
    for s, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        # on the sorted line, what a vector can reach is a range
        own = s + np.argsort(rows.at[s : s + m, 0], kind="stable")
        line = rows.at[own, 0]
        right = np.searchsorted(line, line + reach, "right")
        for k in range(0, m, 64):
            i, j = np.meshgrid(np.arange(k, min(k + 64, m)), np.arange(k, m), indexing="ij")
            keep = (j > i) & (j < right[i])
            i, j = own[i[keep]], own[j[keep]]
            for c in range(0, len(i), CHUNK):
                yield i[c : c + CHUNK], j[c : c + CHUNK]


def _pairs(threshold: float, count: int, kind: type):
    """Links per member, (rep, links, root), of tasks that lie together in the partition; a task cut by a batch is held for the next."""
    task, reach = ("tree", "node", "lo", "hi"), 5 * _spread(threshold)  # beyond five deviations of a pair at the threshold

    def found(table: pa.Table, start: np.ndarray) -> pa.RecordBatch:
        rows = _Bucketed(table, kind)
        size = np.diff(np.append(start, table.num_rows))
        total, root = np.zeros(table.num_rows, np.int64), rows.rep.copy()
        links = [rows.linked(i, j, threshold, count) for i, j in _candidates(rows, start, size, reach)]
        if links:
            ia, ib = (np.concatenate([x[k] for x in links]) for k in (0, 1))
            np.add.at(total, ia, rows.copies[ib])
            np.add.at(total, ib, rows.copies[ia])
            while len(ia):  # least representative reachable inside the task
                new = root.copy()
                np.minimum.at(new, ia, root[ib])
                np.minimum.at(new, ib, root[ia])
                if (new == root).all():
                    break
                root = new
        has = total > 0
        return pa.RecordBatch.from_arrays([pa.array(rows.rep[has]), pa.array(total[has]), pa.array(root[has])], names=["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                held.append(batch.slice(k, 4096))
                table = pa.Table.from_batches(held).combine_chunks()
                columns = [table[c].to_numpy() for c in task]
                new = np.ones(table.num_rows, bool)
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
                start = np.flatnonzero(new)
                last = int(start[-1])  # its task may go on
                if last:
                    yield found(table.slice(0, last), start[:-1])
                held = table.slice(last).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows > 1:
                yield found(table, np.zeros(1, np.int64))

    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.9995, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    if meeting_recall(threshold) < 0.999:
        raise ValueError(f"compound keys of {TABLES} tables miss a recall of 0.999 at cosine {threshold}")
    count = required_count(threshold, recall)
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind, ddl = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    sound = F.col("label").isNotNull() & F.expr("size(emb) > 0 and forall(emb, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(emb, x -> x <> 0)")
    rows = vectors.select(doc_key(id_col).alias("vec"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast(ddl).alias("emb"))
    # equal vectors of a label are one class; a vector that links with nothing is none
    rows = rows.select("vec", "label", "emb", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", "emb")).alias("rep"), F.xxhash64(F.lit(1), "label", "emb").alias("rep2"))
    known = rows.filter("rep is not null")
    classes = known.groupBy("rep", "rep2").agg(F.count("*").alias("copies"), F.min("vec").alias("least"), F.first("label").alias("label"), F.first("emb").alias("emb"))
    classes = classes.select(F.xxhash64("rep", "rep2").alias("rep"), "copies", F.xxhash64("label").alias("label"), "emb", "least")
    classes = written(classes, "classes")
    body = written(classes.select("rep", "copies", "label", "emb").mapInArrow(_keyed, "rep long, copies long, v binary, keys binary"), "keyed")
    met = body.select("rep", F.posexplode(F.expr(f"transform(sequence(0, {TABLES - 1}), t -> substring(keys, 4 * t + 1, 4))")).alias("tree", "key"))
    met = met.select("rep", "tree", F.xxhash64("key").alias("node"))
    middle = centres(met, body.select("rep", "copies", "v"), _distances(threshold, kind), _consensus(kind), block)
    nodes = written(distinct_nodes(met), "nodes")
    task = ["tree", "node", "lo", "hi"]
    parts = tasks(met, nodes, middle, block).join(body, "rep").repartition(*task).sortWithinPartitions(*task)
    checked = written(parts.mapInArrow(_pairs(threshold, count, kind), "rep long, links long, root long"), "links")
    counted, edges = checked.select("rep", "links"), checked.select(F.col("rep").alias("u"), F.col("root").alias("v"))
    if middle is not None:
        counted = counted.unionByName(proved(middle))
        edges = edges.unionByName(proved_edges(middle))
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("rep", "copies", "least").join(links, "rep", "left").join(connected_components(edges).withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    named = named.join(first, "component").select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first")
    out = rows.select("vec", F.when(F.col("rep").isNotNull(), F.xxhash64("rep", "rep2")).alias("rep")).join(named, "rep", "left").withColumn("first", F.coalesce("first", "vec"))
    return out.select(real_id("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), real_id("first").alias("component_id"), (F.col("vec") == F.col("first")).alias("kept"))


__all__ = ["embedding_links", "lines", "meeting_recall", "required_count"]
