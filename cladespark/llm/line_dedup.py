"""Line dedup over a range-partitioned, secondarily sorted table of line hashes.

A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased. Only 128-bit key hashes, document ids and line numbers are dealt
out; the texts stay where they are. Hashes are range-partitioned by
(hash, document) and sorted by (hash, document descending, line number), so a
stream over a partition meets the holder that keeps the line first and can
decide every later occurrence at once, with at most two documents' lines of
one hash in memory. A hash that a third of all lines share is spread over as
many partitions as it needs: the runs at the two ends of each partition are
left open and closed with a table of at most two rows per partition.

What comes back is a zlib-compressed keep bitmap for each document that loses
lines. Documents without a row keep everything.

Defined cases: a null text is one empty line; keys shorter than
``min_chars`` code points always stay; rows that repeat a ``doc_id`` count as
one document, each row is cut by its own bitmap and equal rows get equal
results; a null ``doc_id`` is one document that sorts below all others; an
empty table gives an empty table; further columns are ignored by
``keep_bitmaps`` and kept by ``apply_bitmaps`` whatever their names (save ``_n_lines`` and
``_n_dropped``, which it sets).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from cladespark.llm.common import ASCII_SPACE, NULL_ID, doc_key, free_names, real_id, written

DROP, OPEN, SUMMARY = 0, 1, 2
_MARK = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])
_MARK_DDL = "kind tinyint, h1 long, h2 long, doc long, row long, pos int, n_lines int"


def line_keys(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line whose key is long enough: (h1, h2, doc, row, pos, n_lines)."""
    rows = docs.select(doc_key(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc", F.xxhash64("t").alias("row"), F.split("t", "\n", -1).alias("lines"))
    rows = rows.select("doc", "row", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    rows = rows.withColumn("line", F.expr(f"trim(BOTH '{_sql(ASCII_SPACE)}' FROM line)"))
    rows = rows.filter(F.char_length("line") >= min_chars)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = rows.withColumn("line", F.translate("line", upper, upper.lower()))
    return rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc", "row", "pos", "n_lines")


def _sql(chars: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in chars)


def _stream(min_docs: int):
    """A pass over one sorted partition: rows to drop, rows still open, and a summary of the runs at both ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # rows of the last run, not yet decided
        passed: tuple | None = None  # the last run's hash, once its rows have been let go
        first: tuple | None = None  # hash of the partition's first run
        ends: dict[tuple, list[int]] = {}  # hash of an end run -> [documents, largest document]
        last_doc = None

        def out(kind: int, rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int8)), *(pa.array(rows[:, i]) for i in range(4)), pa.array(rows[:, 4].astype(np.int32)), pa.array(rows[:, 5].astype(np.int32))], schema=_MARK)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)], axis=1)
            if held is not None and len(held):
                rows = np.concatenate([held, rows])
            held = None
            if first is None:
                first = tuple(rows[0, :2])
            new_run = np.ones(len(rows), bool)
            new_run[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            starts = np.flatnonzero(new_run)
            new_doc = new_run.copy()
            new_doc[1:] |= rows[1:, 2] != rows[:-1, 2]
            run_of = np.cumsum(new_run) - 1
            n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            top = rows[starts, 2]
            final = np.ones(len(starts), bool)
            final[-1] = False
            special = np.zeros(len(starts), bool)
            begun = tuple(rows[0, :2])
            if begun == first:  # open: an earlier partition may hold its largest document
                special[0] = True
                e = ends.setdefault(first, [0, int(top[0])])
                e[0] += int(n_docs[0]) - (passed == first and last_doc == rows[0, 2])
                yield out(OPEN, rows[run_of == 0])
                passed = first
            elif passed == begun:  # already known to be in enough documents
                special[0] = True
                own = rows[run_of == 0]
                yield out(DROP, own[own[:, 2] != ends["top"][1]])
            last = len(starts) - 1
            if not special[last]:
                passed = None
                if n_docs[last] >= min_docs:
                    passed = tuple(rows[-1, :2])
                    ends["top"] = [0, int(top[last])]
                    ends["run"] = [int(n_docs[last]), int(top[last])]
                    final[last] = True
                else:
                    held = rows[starts[last] :]
            elif passed != first and "run" in ends:
                ends["run"][0] = max(ends["run"][0], min_docs)
            gone = (final & ~special & (n_docs >= min_docs))[run_of] & (rows[:, 2] != top[run_of])
            if gone.any():
                yield out(DROP, rows[gone])
            last_doc = rows[-1, 2]
        if first is None:
            return
        sums = [(*first, *ends[first])]
        if held is not None and len(held):
            docs = held[:, 2]
            sums.append((*held[0, :2], 1 + int((docs[1:] != docs[:-1]).sum()), int(docs[0])))
            yield out(OPEN, held)
        elif passed is not None and passed != first:
            sums.append((*passed, *ends["run"]))
        table = np.array([(a, b, doc, n, 0, 0) for a, b, n, doc in sums], np.int64)
        yield out(SUMMARY, table)

    return run


def keep_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, n_lines, n_dropped, keep): a compressed keep bitmap for each document that loses lines.

    ``doc`` is the id (``NULL_ID`` for null) and ``row`` the xxhash64 of the
    text, which tells apart rows that repeat an id.
    """
    keys = written(line_keys(docs, min_chars, id_col, text_col), "line_keys")  # the range sampling reads hashes, not texts
    dealt = keys.repartitionByRange("h1", "h2", F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.col("doc").desc(), "row", "pos")
    marks = written(dealt.mapInArrow(_stream(min_docs), _MARK_DDL), "line_marks")
    # at most two rows per partition; stored, so the planner knows the size and broadcasts below its threshold
    ends = marks.filter(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("row").alias("n"), F.max("doc").alias("top"))
    ends = written(ends.filter(F.col("n") >= min_docs), "ends")
    closed = marks.filter(F.col("kind") == OPEN).join(ends, ["h1", "h2"]).filter(F.col("doc") != F.col("top"))
    own = ["doc", "row", "pos", "n_lines"]
    drops = marks.filter(F.col("kind") == DROP).select(own).unionByName(closed.select(own))
    lost = drops.groupBy("doc", "row", "n_lines").agg(F.collect_set("pos").alias("lost"))
    return lost.select("doc", "row", "n_lines", F.size("lost").alias("n_dropped"), _packed("lost", "n_lines").alias("keep"))


@F.pandas_udf(BinaryType())
def _packed(lost: pd.Series, n_lines: pd.Series) -> pd.Series:
    def pack(gone: np.ndarray, n: int) -> bytes:
        keep = np.ones(n, bool)
        keep[gone] = False
        return zlib.compress(np.packbits(keep).tobytes(), 1)

    return pd.Series([pack(np.asarray(a, np.int64), n) for a, n in zip(lost, n_lines)], dtype=object)


@F.pandas_udf(StringType())
def _cut(text: pd.Series, keep: pd.Series) -> pd.Series:
    def cut(t: str | None, bits: bytes | None) -> str | None:
        if bits is None or t is None:
            return t
        lines = t.split("\n")
        mask = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
        return "\n".join([x for x, k in zip(lines, mask.tolist()) if k])

    return pd.Series([cut(t, b) for t, b in zip(text, keep)], dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that their bitmaps drop cut out, plus ``_n_lines`` and ``_n_dropped``."""
    k_doc, k_row, b_doc, b_row, lost, keep = free_names(docs, "k_doc", "k_row", "b_doc", "b_row", "lost", "keep")
    small = bitmaps.select(F.col("doc").alias(b_doc), F.col("row").alias(b_row), F.col("n_dropped").alias(lost), F.col("keep").alias(keep))
    left = docs.withColumns({k_doc: doc_key(id_col), k_row: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    # bitmaps are far smaller than texts: they are the hashed side, so texts are dealt out but not sorted
    both = left.join(small.hint("shuffle_hash"), (F.col(k_doc) == F.col(b_doc)) & (F.col(k_row) == F.col(b_row)), "left")
    breaks = F.coalesce(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))), F.lit(0))
    both = both.withColumns({"_n_lines": (breaks + 1).cast("long"), "_n_dropped": F.coalesce(F.col(lost), F.lit(0)).cast("long")})
    both = both.withColumn(text_col, _cut(F.col(text_col), F.col(keep)))
    return both.drop(k_doc, k_row, b_doc, b_row, lost, keep)


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` documents share, save in the largest id holding each."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars, id_col, text_col), id_col, text_col)


__all__ = ["NULL_ID", "apply_bitmaps", "keep_bitmaps", "line_dedup", "line_keys", "real_id"]
