"""LM scoring with a probabilistic suffix tree.

A text is the sequence of its tokens: words between ASCII white space, A-Z
lower-cased, then one end. The tree models that sequence spelled out in bytes
with one space between words, so its probabilities are proper ones for token
sequences and a word never met still gets one. A node is a context of up to
``DEPTH`` bytes. Counts of all contexts come from grouped sums over the whole
training corpus; a context is kept when its next-byte distribution diverges
from that of its parent (the context without its oldest byte) by more than a
penalty for its parameters, and distributions are smoothed towards the parent's
(Witten-Bell). Every context that passes the test is kept, with its suffixes.
Scoring uses the longest kept suffix at each byte: kept contexts and the bytes
after them go to the executors as sorted arrays, about 12 bytes for each, and
each distinct gram of a batch is looked up once.

The unigram base that the contract asks for needs exact counts of every token.
The most frequent words (at most ``FREQUENT``) are looked up where the text is
read; all others meet the counts in a join.

Defined cases: null and empty texts are one end; rows that repeat a ``doc_id``
count each and are scored each; a null ``doc_id`` hashes like the empty text;
an untrained model (no training rows) gives every byte the same probability;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.llm.common import bounded_batches, crc_mod, sliced, written

#: Bytes of the longest context, words looked up in place at most.
DEPTH, FREQUENT = 6, 200_000
#: Least count of a context, and the penalty (in nats) for each symbol that follows it.
LEAST, PENALTY = 30, 4.0
#: Symbols that no token holds: the end and what stands before the start.
END, PAD = 9, 10
#: Texts are scored in pieces of so many bytes, with DEPTH bytes before them as their context.
PIECE = 1 << 21
END_WORD = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """Words of a text without its end. bytes.lower() and bytes.split() know ASCII only, as the contract asks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "c"])
        held.clear()
        return made

    for batch in sliced(batches):
        for text in batch.column(0).to_pylist():
            held.update(tokens(text))
            held[END_WORD] += 1
        if len(held) > 400_000:
            yield out()
    if held:
        yield out()


def _grams(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad, keys, counts, held = bytes([PAD]) * depth, [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, c = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            return k[starts], np.add.reduceat(c, starts)

        for batch in sliced(batches, rows=2048, megabytes=4):
            data = np.frombuffer(b"".join(pad + b" ".join(tokens(t)) + bytes([END]) for t in batch.column(0).to_pylist()), np.uint8)
            if len(data) <= depth:
                continue
            key = np.zeros(len(data) - depth, np.uint64)
            for i in range(depth + 1):
                key = (key << np.uint64(8)) | data[i : len(data) - depth + i]
            k, c = np.unique(key[data[depth:] != PAD], return_counts=True)
            keys.append(k)
            counts.append(c.astype(np.int64))
            held += len(k)
            if held > 6_000_000:
                k, c = merged()
                keys, counts, held = [k], [c], len(k)
                if held > 3_000_000:
                    yield from _key_batches(k, c)
                    keys, counts, held = [], [], 0
        if keys:
            yield from _key_batches(*merged())

    return run


def _key_batches(k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(k), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 200_000].astype(np.int64)), pa.array(c[i : i + 200_000])], names=["key", "c"])


def _cutoff(df: DataFrame, column: str, most: int) -> float:
    """A value such that at most ``most`` rows of ``df`` reach it, from a histogram of 16 bins an octave."""
    bins = df.groupBy(F.floor(F.log2(column) * 16).alias("b")).agg(F.count("*").alias("n")).collect()
    total = 0
    for row in sorted(bins, key=lambda r: -r["b"]):
        total += row["n"]
        if total > most:
            return 2 ** ((row["b"] + 1) / 16)
    return 0.0


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition that holds whole contexts: each gram once, with its count and its context's."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    key, c = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(key, kind="stable")
    key, c = key[order], c[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, c = key[start], np.add.reduceat(c, start)
    ctx = key >> 8
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
    n = np.repeat(np.add.reduceat(c, first), np.diff(np.append(first, len(key))))
    for i in range(0, len(key), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in (key, c, n)], names=["key", "c", "n"])


def train(docs: DataFrame, text_col: str = "text", depth: int = DEPTH) -> Tree:
    """The tree from all rows of ``docs``."""
    texts = docs.select(F.col(text_col).alias("text"))

    def context(column: str = "key"):
        return F.shiftrightunsigned(column, 8)

    # (key, c, n) for each order: gram, its count, its context's count. Orders nest: each comes from the next longer one, not from the texts
    level: dict[int, DataFrame] = {}
    for k in range(depth, -1, -1):
        if k == depth:
            own = texts.mapInArrow(_grams(depth), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
        else:
            own = level[k + 1].groupBy(F.col("key").bitwiseAND(2 ** (8 * (k + 1)) - 1).alias("key")).agg(F.sum("c").alias("c"))
        level[k] = written(own.repartition(context()).mapInArrow(_merged, "key long, c long, n long"), f"grams{k}")
    found = None
    for k in range(1, depth + 1):
        # a context met often enough has suffixes met at least as often, so light ones take no part on either side
        own = level[k].filter(F.col("n") >= LEAST).withColumn("up_key", F.col("key").bitwiseAND(2 ** (8 * k) - 1))
        up = level[k - 1].filter(F.col("n") >= LEAST).select(F.col("key").alias("up_key"), F.col("c").alias("up_c"), F.col("n").alias("up_n"))
        gain = F.sum(F.col("c") * F.log((F.col("c") / F.col("n")) / (F.col("up_c") / F.col("up_n"))))
        kept = own.join(up, "up_key").groupBy(context().alias("ctx")).agg(gain.alias("gain"), F.count("*").alias("t")).filter(F.col("gain") > PENALTY * F.col("t"))
        kept = kept.select(F.lit(k).alias("k"), "ctx")
        found = kept if found is None else found.unionByName(kept)
    found = written(found, "contexts")
    nodes: dict[int, DataFrame] = {}
    for k in range(depth, 0, -1):  # a tree: with a context go all its suffixes
        own = found.filter(F.col("k") == k).select("ctx")
        nodes[k] = written((own.unionByName(nodes[k + 1].select(F.col("ctx").bitwiseAND(2 ** (8 * k) - 1).alias("ctx"))) if k < depth else own).distinct(), f"nodes{k}")
    tree = Tree(depth=depth, levels=[])
    up_keys, up_p = np.zeros(0, np.int64), np.zeros(0)
    for k in range(depth + 1):
        rows = level[k].filter(F.col("n") >= LEAST).join(nodes[k], context() == F.col("ctx")) if k else level[k]
        got = rows.select("key", "c").toArrow()
        keys, c = got["key"].to_numpy(), got["c"].to_numpy()
        order = np.argsort(keys)
        keys, c = keys[order], c[order]
        ctx, start, kinds = np.unique(keys >> 8, return_index=True, return_counts=True)
        n = np.add.reduceat(c, start) if len(c) else c
        parent = up_p[np.searchsorted(up_keys, keys & (2 ** (8 * k) - 1))] if k else np.full(len(keys), 1 / 256)
        p = (c + np.repeat(kinds, kinds) * parent) / np.repeat(n + kinds, kinds)
        back, grams = backwards(ctx, k), backwards(keys >> 8, k) << 8 | keys & 255
        at, gram_at = np.argsort(back), np.argsort(grams)
        tree["levels"].append((back[at], np.log10(kinds / (n + kinds)).astype(np.float32)[at], grams[gram_at], np.log10(p).astype(np.float32)[gram_at]))
        up_keys, up_p = keys, p
    seen = np.zeros(256, bool)
    seen[tree["levels"][0][2]] = True
    tree["classes"] = np.where(seen, np.cumsum(seen), 0).astype(np.int32)  # class 0: bytes not seen in training
    tree["classes"][PAD] = seen.sum() + 1
    return tree


def backwards(ctx: np.ndarray, k: int) -> np.ndarray:
    """Contexts of k bytes with the newest byte first: in that order all lengths of sorted contexts are sorted."""
    return (ctx << (8 * (8 - k))).byteswap() if k else ctx


class Tree(dict):
    """The kept contexts as sorted arrays, for each length: contexts (newest byte first), log10 weight of the parent's
    distribution, grams (a context and the byte after it), their log10 probability. ``logp``, every context's probabilities of every class of
    bytes, is made only where someone asks for it."""

    def __missing__(self, name: str) -> np.ndarray:
        if name != "logp":
            raise KeyError(name)
        classes = self["classes"]
        symbols = np.array([np.argmax(classes == i) for i in range(classes.max() + 1)], np.int64)
        return np.concatenate([gram_probability(self, ((ctx << (8 * (self["depth"] - k + 1)))[:, None] | symbols).ravel(), k).reshape(-1, len(symbols)) for k, (ctx, *_) in enumerate(self["levels"])])


def gram_probability(model: dict, keys: np.ndarray, longest: int) -> np.ndarray:
    """log10 probability of the last byte of each key after the longest kept context that its other bytes, newest first, begin with."""
    out, rest = np.full(len(keys), -np.log10(256)), np.arange(len(keys))
    for k, (ctx, back, grams, logp) in enumerate(model["levels"][: longest + 1]):
        if not len(ctx) or not len(rest):
            break
        own = keys[rest] >> (8 * (model["depth"] - k + 1))
        at = np.searchsorted(ctx, own).clip(max=len(ctx) - 1)
        kept = ctx[at] == own
        rest, at = rest[kept], at[kept]  # a context is kept only if its suffixes are
        own = own[kept] << 8 | keys[rest] & 255
        gram = np.searchsorted(grams, own).clip(max=len(grams) - 1)
        out[rest] = np.where(grams[gram] == own, logp[gram], out[rest] + back[at])
    return out


def routes(model: dict) -> dict[str, np.ndarray]:
    """The tree as it is scored with: one sorted table that finds the longest kept suffix of any history in one search.

    Written newest byte first, the histories that end in a context are an interval of
    numbers. ``bounds`` are the places where the longest kept context changes and
    ``node`` which it is from there on; ``codes`` are (node, next byte) of the grams met, with
    ``logp``; ``back`` and ``parent`` lead to shorter contexts for the others.
    """
    depth, levels = model["depth"], [(ctx, back, grams, logp) for ctx, back, grams, logp in model["levels"]]
    if not len(levels[0][0]):  # nothing learned: a root that has met nothing
        levels[0] = (np.zeros(1, np.int64), np.zeros(1, np.float32), np.zeros(0, np.int64), np.zeros(0, np.float32))
    first = np.concatenate([[0], np.cumsum([len(x[0]) for x in levels])])
    edges = [(ctx + more) << (8 * (depth - k)) for k, (ctx, *_) in enumerate(levels) for more in (0, 1)]
    bounds = np.unique(np.concatenate(edges))
    node, rest = np.zeros(len(bounds), np.int32), np.arange(len(bounds))
    parent, codes = [np.zeros(1, np.int32)], []
    for k, (ctx, _, grams, _) in enumerate(levels):
        if k:
            if not len(ctx):
                break
            own = bounds[rest] >> (8 * (depth - k))
            at = np.searchsorted(ctx, own).clip(max=len(ctx) - 1)
            kept = ctx[at] == own
            rest, at = rest[kept], at[kept]
            node[rest] = first[k] + at
            parent.append((first[k - 1] + np.searchsorted(levels[k - 1][0], ctx >> 8)).astype(np.int32))
        codes.append((first[k] + np.searchsorted(ctx, grams >> 8)) << 8 | grams & 255)
    change = np.concatenate([[True], node[1:] != node[:-1]])
    return {"depth": depth, "bounds": bounds[change], "node": node[change], "parent": np.concatenate(parent), "back": np.concatenate([x[1] for x in levels]), "codes": np.concatenate(codes), "logp": np.concatenate([x[3] for x in levels])}


def routed_probability(table: dict, keys: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each key after its other bytes, newest first."""
    codes, logp, back, parent = (table[c] for c in ("codes", "logp", "back", "parent"))
    node = table["node"][np.searchsorted(table["bounds"], keys >> 8, "right") - 1]
    symbol, out, rest = keys & 255, np.zeros(len(keys)), np.arange(len(keys))
    while len(rest):
        code = node.astype(np.int64) << 8 | symbol
        at = np.searchsorted(codes, code).clip(max=max(0, len(codes) - 1))
        met = codes[at] == code if len(codes) else np.zeros(len(code), bool)
        out[rest[met]] += logp[at[met]]
        rest, node, symbol = rest[~met], node[~met], symbol[~met]
        out[rest] += back[node]
        root = node == 0
        out[rest[root]] -= math.log10(256)
        rest, node, symbol = rest[~root], parent[node[~root]], symbol[~root]
    return out


def log10_probability(model: dict, texts: list[list[bytes]]) -> np.ndarray:
    """log10 probability of each token list; each distinct gram of a piece is looked up once. ``model`` is a tree or its routes."""
    table = model if "bounds" in model else routes(model)
    depth = table["depth"]
    pad = bytes([PAD]) * depth
    spelled = [pad + b" ".join(words) + bytes([END]) for words in texts]
    owner = np.repeat(np.arange(len(spelled), dtype=np.int32), [len(x) for x in spelled])
    data = np.frombuffer(b"".join(spelled), np.uint8)
    total = np.zeros(len(spelled))
    for start in range(0, len(data) - depth, PIECE):
        piece = data[start : start + PIECE + depth]
        # the bytes before a place, newest first, then the byte itself
        key = piece[:-depth].astype(np.int64) << 8
        for i in range(1, depth):
            key |= piece[i : len(piece) - depth + i].astype(np.int64) << (8 * (i + 1))
        key |= piece[depth:]
        own = piece[depth:] != PAD
        coded = pa.array(key[own]).dictionary_encode()
        keys = coded.dictionary.to_numpy()
        order = np.argsort(keys)  # sorted keys are found several times faster
        value = np.empty(len(keys))
        value[order] = routed_probability(table, keys[order])
        total += np.bincount(owner[start + depth : start + len(piece)][own], value[coded.indices.to_numpy()], len(spelled))
    return total


def _lookup(model) -> dict[bytes, float]:
    """The broadcast words as a dictionary, made once in each worker."""
    value = model.value
    if "lookup" not in value:  # kept beside the value, so it goes when the broadcast does
        value["lookup"] = dict(zip(value["words"].to_pylist(), value["x"].tolist()))
    return value["lookup"]


def score(docs: DataFrame, training: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for all ``docs``, learned from ``training``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counted = training.select(F.col(text_col).alias("text")).mapInArrow(_counted_words, "word binary, c long")
    vocab = written(counted.groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    row = vocab.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(row["n"] or 0), int(row["v"])
    norm = math.log10(n + 0.5 * (v + 1))
    cut = _cutoff(vocab, "c", frequent)
    near = (F.col("c") >= cut) & (F.length("word") <= 48)
    tree = train(training, text_col, **options)
    table = vocab.filter(near).select("word", (F.log10(F.col("c") + 0.5) - norm).alias("x")).toArrow()  # columns take far less than rows
    model = spark.sparkContext.broadcast({"tree": routes(tree), "words": table["word"].combine_chunks(), "x": table["x"].to_numpy()})
    del table, tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, words = model.value["tree"], _lookup(model)
        row_id = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, rows=1024, megabytes=3):
            lists = [tokens(t) for t in batch.column(2).to_pylist()]
            lp = log10_probability(tree, lists)
            size = batch.num_rows
            for own in lists:
                own.append(END_WORD)
            n_tokens = np.array([len(x) for x in lists], np.int64)
            owner = np.repeat(np.arange(size), n_tokens)
            coded = pa.array([w for own in lists for w in own], pa.binary()).dictionary_encode()
            distinct, at = coded.dictionary, coded.indices.to_numpy()
            x = np.array([words.get(w, np.nan) for w in distinct.to_pylist()], np.float64)[at]
            near = ~np.isnan(x)
            base, known = np.bincount(owner[near], x[near], size), np.bincount(owner[near], minlength=size)
            # the others, once for each text with how often, to meet the counts in a join
            pair, times = np.unique(owner[~near] * max(1, len(distinct)) + at[~near], return_counts=True)
            ends = pa.array(np.searchsorted(pair // max(1, len(distinct)), np.arange(size + 1)), pa.int32())
            rest_words = pa.ListArray.from_arrays(ends, distinct.take(pa.array(pair % max(1, len(distinct)))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row_id, row_id + size)), batch.column(0), batch.column(1), pa.array(n_tokens), pa.array(known.astype(np.int64)), pa.array(base.astype(np.float64)), pa.array(lp, pa.float64()), rest_words, pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))],
                names=["rid", "id", "held_out", "n_tokens", "known", "base", "score", "words", "times"],
            )
            row_id += size

    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    done = written(rows.mapInArrow(run, f"rid long, id {kind}, held_out boolean, n_tokens long, known long, base double, score double, words array<binary>, times array<long>"), "scored")
    rest = done.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = rest.join(vocab.filter(~near), "word", "left")
    more = met.groupBy("rid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - norm)).alias("rest"))
    out = done.drop("words", "times").join(more, "rid", "left")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")


def score_corpus(docs: DataFrame, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Learn from the documents outside one fold of crc32(id) and score all."""
    held_out = crc_mod(id_col, folds) == fold
    return score(docs, docs.filter(~held_out), held_out, id_col, text_col, **options)
