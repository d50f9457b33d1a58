"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

Texts whose shingle sets are equal form one class, so copies cost one
representative. Each class has, in each of ``trees`` trees, a path of MinHash
values; the paths of a tree, range-partitioned and sorted, are its prefix trie
laid out flat. The join descends level by level from the full paths: at each
depth only pairs are verified that share a node there but met in no deeper one.
After a level the verified similarities give the recall so far: a pair of
similarity s shares a prefix of depth d with chance 1-(1-s^d)^trees, so each link
found stands for that many links. The descent ends when the estimate reaches the
target, so tightly copied corpora stop at long prefixes and looser ones go on, at
the latest at the depth where a pair right at the threshold reaches the target by
that law (0.999 at 0.8 gives depth 4 for 16 trees; if there is none, an error).

Nodes with equal member sets are checked once. Nodes with many members follow
``near_groups``: links proved by the triangle inequality of the Jaccard distance
are counted from distances to a centre, the others are verified in blocks, each
pair of blocks a task of bounded size. A pair of texts is counted in the first
tree where both share a node. Verification is exact on 64-bit shingle hashes. A
task returns one row per member (links, weighted by copies, and its local
component), never a row per pair.

Defined cases: words are lower-cased runs without white space; a text of one
to four words is one shingle; texts without words (null, empty) are copies of
each other; rows that repeat a ``doc_id`` are texts of their own; a null id
sorts below all others; an empty table gives an empty table; further columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.llm.common import bounded_batches, doc_key, free_names, give_back, real_id, sliced, written
from cladespark.llm.components import connected_components
from cladespark.llm.near_groups import UNITS, centres, distinct_nodes, proved, proved_edges, proved_mask, tasks

WORDS, TREES, LEVELS, BLOCK = 5, 16, 6, 512
#: Verified similarities are counted in hundredths.
BINS = 100
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that all bits depend on all bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams; words' hashes are cached in a bounded table."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def _hash(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= 150_000:
                self.known.clear()
            found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
            if len(word) <= 64:
                self.known[word] = found
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if not words:
            return np.zeros(0, _U)
        known = self.known.get
        h = np.array([known(w) or self._hash(w) for w in words], _U)
        width = min(self.words, len(words))
        n = len(words) - width + 1
        out = np.full(n, len(words) if width < self.words else self.words, _U)
        for i in range(width):
            out = out * _MULT + h[i : i + n]
            out ^= out >> _U(29)
        return np.unique(_mix(out))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | _U(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minhash(shingles: np.ndarray, n: int) -> np.ndarray:
    """n 32-bit MinHash values (all ones for an empty set)."""
    a, b = _permutations(n)
    best = np.full(n, 2**32 - 1, np.uint32)
    for start in range(0, len(shingles), 2048):
        part = shingles[start : start + 2048]
        np.minimum(best, ((part[:, None] * a + b) >> _U(32)).astype(np.uint32).min(axis=0), out=best)
    return best


def forest_depth(threshold: float, recall: float, trees: int = TREES, levels: int = LEVELS) -> int:
    """The longest prefix at which a pair at the threshold shares a node of some tree with the target recall."""
    for depth in range(levels, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError(f"{trees} trees miss recall {recall} at threshold {threshold} even at depth 1")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, s1, s2, n, paths): id, hash of the text, 128-bit hash of the shingle set, its size and its MinHash paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in sliced(batches):
            keys, sizes, paths = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle(text)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                paths.append(minhash(s, TREES * LEVELS).astype(">u4").tobytes())
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes, pa.int32()), pa.array(paths, pa.binary())], names=["doc", "row", "s1", "s2", "n", "paths"])
        give_back(shingle.known)

    rows = docs.select(doc_key(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc long, row long, s1 long, s2 long, n int, paths binary")


def _matched(depth: int):
    """Of a sorted partition, the rows that share a prefix of ``depth`` with a neighbour, and the two end rows."""
    width = 4 * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_kept = None, True

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["tree", "path", "rep"])

        for batch in batches:
            kept = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                same = last is not None and last[0] == row[0] and last[1][:width] == row[1][:width]
                if same and not last_kept:
                    kept.append(last)
                if same or last is None:
                    kept.append(row)
                last, last_kept = row, same or last is None
            if kept:
                yield out(kept)
        if last is not None and not last_kept:
            yield out([last])

    return run


def tries(reps: DataFrame, depth: int) -> DataFrame:
    """(tree, path, rep): the sorted paths of each tree, without those that no other path meets even at ``depth``."""
    paths = reps.select("rep", F.posexplode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> substring(paths, t * {4 * LEVELS} + 1, {4 * LEVELS}))")).alias("tree", "path"))
    trie = paths.select("tree", "path", "rep").repartitionByRange("tree", "path", "rep").sortWithinPartitions("tree", "path", "rep")
    return written(trie.mapInArrow(_matched(depth), "tree int, path binary, rep long"), "trie")


def level(trie: DataFrame, depth: int) -> DataFrame:
    """(tree, node, child, rep): each path cut at ``depth``; child is the node one level deeper."""
    return trie.select("tree", F.xxhash64(F.substring("path", 1, 4 * depth)).alias("node"), F.xxhash64(F.substring("path", 1, 4 * depth + 4)).alias("child"), "rep")


def recall_estimate(found: dict[int, int], depth: int) -> float:
    """Share of links met by prefixes of ``depth`` or longer, from the verified similarities of those met.

    A pair of similarity s shares such a prefix with chance p(s), so each link
    found stands for 1/p(s) links. Without links it is 0, so the descent goes on.
    """
    there = sum(n / (1 - (1 - (b / BINS) ** depth) ** TREES) for b, n in found.items())
    return sum(found.values()) / there if there else 0.0


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    for batch in sliced(batches, rows=64):
        sets = [shingle(text) for text in batch.column(2).to_pylist()]
        paths = [minhash(x, TREES * LEVELS).astype(">u4").tobytes() for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(paths, pa.binary())], names=["rep", "copies", "sh", "paths"])
    give_back(shingle.known)


def _consensus(table: pa.Table) -> pa.Table:
    """The shingles that more than half of the sets hold."""
    sets = [np.frombuffer(x.as_py(), _U) for x in table["sh"]]
    value, n = np.unique(np.concatenate(sets), return_counts=True)
    return pa.table({"leader": table["leader"].slice(0, 1), "centre": pa.array([value[2 * n > len(sets)].tobytes()], pa.binary())})


def _distances(threshold: float):
    """(rep, leader, near, copies) of (rep, leader, copies, sh, centre)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for own, head in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                a, b = np.frombuffer(own, _U), np.frombuffer(head, _U)
                both = len(np.intersect1d(a, b, assume_unique=True))
                far = 1 - both / (len(a) + len(b) - both)
                near.append(min(UNITS + 1, math.ceil(far / (1 - threshold) * UNITS + 1e-6)) if far else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), batch.column(2)], names=["rep", "leader", "near", "copies"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products over the values that more than one set holds."""
    n = len(sets)
    if n == 2:
        x = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), x], [x, len(sets[1])]], np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    owner, column = owner[use], column[inverse[use]]
    total = np.zeros((n, n), np.float64)
    for start in range(0, int(shared.sum()), 4096):
        own = (column >= start) & (column < start + 4096)
        part = np.zeros((n, 4096), np.float32)
        part[owner[own], column[own] - start] = 1
        total += part @ part.T
    return total


def local_components(links: np.ndarray) -> np.ndarray:
    """The least index that each index reaches in a symmetric Boolean matrix."""
    n = len(links)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(links, label[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(threshold: float, depth: int):
    """Links of one task: pairs that share no longer prefix in any tree and none of ``depth`` in an earlier one."""
    def run(table: pa.Table) -> pa.Table:
        rep, pick = np.unique(table["rep"].to_numpy(), return_index=True)
        copies, blk = table["copies"].to_numpy()[pick], table["blk"].to_numpy()[pick]
        tree, lo, hi = (table[c][0].as_py() for c in ("tree", "lo", "hi"))
        n = len(rep)
        nothing = pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "bin": pa.array([], pa.int32()), "pairs": pa.array([], pa.int64())})
        if n < 2:
            return nothing
        paths = np.stack([np.frombuffer(table["paths"][int(i)].as_py(), ">u4").reshape(TREES, LEVELS) for i in pick])
        leader = table["leader"].fill_null(0).to_numpy()[pick]
        near = table["near"].fill_null(UNITS + 1).to_numpy()[pick]
        allowed = ~np.eye(n, dtype=bool) if lo == hi else blk[:, None] != blk[None, :]
        allowed &= ~proved_mask(leader, near)
        for t in range(TREES):
            for cut, counts in ((depth, t < tree), (depth + 1, depth < LEVELS)):
                if counts and allowed.any():
                    code = np.unique(np.ascontiguousarray(paths[:, t, :cut]).view(f"V{4 * cut}").ravel(), return_inverse=True)[1]
                    allowed &= code[:, None] != code[None, :]
        need = np.flatnonzero(allowed.any(axis=1))
        if not len(need):
            return nothing
        rep, copies, allowed = rep[need], copies[need], allowed[np.ix_(need, need)]
        sets = [np.frombuffer(table["sh"][int(i)].as_py(), _U) for i in pick[need]]
        size = np.array([len(s) for s in sets], np.float64)
        both = intersections(sets)
        union = size[:, None] + size[None, :] - both
        links = allowed & (both + 1e-9 >= threshold * union) & (both > 0)
        weight = links @ copies
        root = rep[local_components(links)]
        has = weight > 0
        of = np.triu(links)
        bins, pairs = np.unique((BINS * both[of] / union[of]).astype(np.int32), return_counts=True)
        blank, zero = [None] * len(bins), [None] * int(has.sum())
        return pa.table({
            "rep": pa.array(rep[has].tolist() + blank, pa.int64()),
            "links": pa.array(weight[has].astype(np.int64).tolist() + blank, pa.int64()),
            "root": pa.array(root[has].tolist() + blank, pa.int64()),
            "bin": pa.array(zero + bins.tolist(), pa.int32()),
            "pairs": pa.array(zero + pairs.tolist(), pa.int64()),
        })

    return run


def ngram_jaccard(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc, row, class_id, n_links, group_id, component).

    ``class_id`` is the least id with the same shingle set, ``n_links`` the
    number of other documents at or above the threshold (copies included) and
    ``group_id`` the least id reachable by links. ``component`` tells groups apart
    whose least ids are equal (null, or repeated with other texts).
    """
    least = forest_depth(threshold, recall)
    bounded_batches(docs.sparkSession)
    sig = written(signatures(docs, id_col, text_col), "signatures")
    classes = sig.groupBy("s1", "s2").agg(F.min(F.struct("doc", "row")).alias("head"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("paths").alias("paths"))
    classes = written(classes.select("s1", "s2", F.col("head.doc").alias("rep_doc"), F.col("head.row").alias("rep_row"), F.xxhash64("head.doc", "s1", "s2").alias("rep"), "copies", "n", "paths"), "classes")
    trie = tries(classes.filter("n > 0").select("rep", "paths"), least)
    wanted = classes.select("rep", "rep_doc", "rep_row", "copies").join(trie.select("rep").distinct(), "rep").hint("shuffle_hash")
    texts = docs.select(doc_key(id_col).alias("d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("r"), F.col(text_col).alias("text"))
    # texts are dealt out once, unsorted; only those with candidates are shingled again, once for all depths
    found = texts.join(wanted, (F.col("d") == F.col("rep_doc")) & (F.col("r") == F.col("rep_row"))).select("rep", "copies", "text")
    sets = written(found.dropDuplicates(["rep"]).mapInArrow(_shingled, "rep long, copies long, sh binary, paths binary"), "shingles")
    middle = centres(level(trie, LEVELS), sets.select("rep", "copies", "sh"), _distances(threshold), _consensus, block)
    checked, similar = [], {}
    for depth in range(LEVELS, least - 1, -1):
        rows = level(trie, depth)
        nodes = written(distinct_nodes(rows, None if depth == LEVELS else F.min("child") != F.max("child")), "nodes")
        part = tasks(rows, nodes, middle, block).join(sets, "rep")
        part = part.groupBy("tree", "node", "lo", "hi").applyInArrow(_verify(threshold, depth), "rep long, links long, root long, bin int, pairs long")
        part = written(part, f"verified{depth}")
        checked.append(part.filter("rep is not null").select("rep", "links", "root"))
        for row in part.filter("rep is null").groupBy("bin").agg(F.sum("pairs").alias("pairs")).collect():  # a row for each similarity in hundredths
            similar[row["bin"]] = similar.get(row["bin"], 0) + row["pairs"]
        if recall_estimate(similar, depth) >= recall:
            break
    edges = reduce(DataFrame.unionByName, checked)
    counted = edges.select("rep", "links")
    edges = edges.select(F.col("rep").alias("u"), F.col("root").alias("v"))
    if middle is not None:
        counted = counted.unionByName(proved(middle))
        edges = edges.unionByName(proved_edges(middle))
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(edges)
    named = classes.select("s1", "s2", "rep", "rep_doc", "copies").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("rep_doc").alias("group_doc"))
    named = named.join(least, "component").select("s1", "s2", "rep_doc", "group_doc", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sig.select("doc", "row", "s1", "s2").join(named, ["s1", "s2"]).select("doc", "row", real_id("rep_doc").alias("class_id"), F.col("n_links").cast("long").alias("n_links"), real_id("group_doc").alias("group_id"), "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the least id (of rows that repeat it, the least text hash, once)."""
    groups = ngram_jaccard(docs, id_col=id_col, text_col=text_col, **options)
    k_doc, k_row, h_doc, h_row = free_names(docs, "k_doc", "k_row", "h_doc", "h_row")
    heads = groups.groupBy("component").agg(F.min(F.struct("doc", "row")).alias("head")).select(F.col("head.doc").alias(h_doc), F.col("head.row").alias(h_row))
    rows = docs.withColumns({k_doc: doc_key(id_col), k_row: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    kept = rows.join(heads.hint("shuffle_hash"), (F.col(k_doc) == F.col(h_doc)) & (F.col(k_row) == F.col(h_row)), "left_semi")
    # rows equal in id and text are copies too, and only they meet here
    return kept.dropDuplicates([k_doc, k_row]).drop(k_doc, k_row)
