"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each leaf of the tree holds, for one symbol and its right neighbour, the rank
of that pair joined with its place, so the root is the leftmost pair of lowest
rank. Nodes have 16 children, so a word of up to 17 symbols is one node. A
merge changes three leaves, each a logarithmic update; the word is done when
the root has no rank. Texts are normalized and cut into words the
way the vocabulary file prescribes, and a file that prescribes anything else is
refused; ids of words met before come from a
bounded cache in each worker.

Defined cases: a null text is the empty text and gives no ids; special tokens
written out in a text become their own ids; symbols that the vocabulary lacks
are left out; texts of any length are encoded whole, a long run of letters in
O(n log n); repeated rows give repeated results; an empty table gives an empty
table; columns other than id and text are ignored.
"""

from __future__ import annotations

import json
import threading
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.llm.common import bounded_batches, give_back, sliced

#: No pair to merge.
NONE = 1 << 62
#: Children of a node of the segment tree; the pairs of most words fit below one root.
FAN = 16
#: Cached chunks and words in each worker; a full cache is emptied, results don't depend on it.
CACHE = 250_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 itself, then code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def check_supported(spec: dict) -> None:
    """ValueError if a file asks for anything that this encoder doesn't do."""
    parts = lambda x, key: [] if x is None else x[key] if x["type"] == "Sequence" else [x]
    steps = [(x["type"], x.get("pattern"), x.get("content")) for x in parts(spec.get("normalizer"), "normalizers")]
    # fixed values: composition, runs of white space to one space, lower case
    if steps != [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]:
        raise ValueError(f"normalizer not supported: {steps}")
    cuts = parts(spec.get("pre_tokenizer"), "pretokenizers")
    if [x["type"] for x in cuts] != ["Split", "ByteLevel"] or (cuts[0]["behavior"], cuts[0]["invert"]) != ("Removed", True) or cuts[1].get("add_prefix_space") or cuts[1].get("use_regex"):
        raise ValueError(f"pre-tokenizer not supported: {cuts}")
    if spec.get("decoder") is not None or spec.get("post_processor") is not None:
        raise ValueError("decoders and post-processors are not supported")
    model = spec["model"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        raise ValueError("only plain BPE models are supported")
    if any(x.get(k) for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with rules of their own are not supported")


class SegmentTreeBpe:
    """A word-level BPE model read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_supported(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces: list[str] = [""] * (max([*self.vocab.values(), *special.values()]) + 1)
        for piece, i in (self.vocab | special).items():
            self.pieces[i] = piece
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.word_re = regex.compile(self._split_pattern(spec["pre_tokenizer"]))
        symbols = byte_symbols()
        self.inner = [self.vocab.get(symbols[b], -1) for b in range(256)]
        self.final = [self.vocab.get(symbols[b] + self.end, -1) for b in range(256)]
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    @staticmethod
    def _split_pattern(pre: dict) -> str:
        split = next(x for x in pre["pretokenizers"] if x["type"] == "Split")
        # white space is the Unicode property, in classes and outside them
        return split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge adjacent symbols by ascending rank, leftmost first, until no pair of them has a rank."""
        n = len(symbols)
        if n < 2:
            return symbols
        pairs = self.pairs.get
        leaves = []
        for pair in zip(symbols, symbols[1:]):
            found = pairs(pair)
            leaves.append(NONE if found is None else found[0] * n + len(leaves))
        levels = [leaves]
        while len(levels[-1]) > FAN:
            low = levels[-1]
            levels.append([min(low[k : k + FAN]) for k in range(0, len(low), FAN)])
        top = levels[-1]
        after, before, symbols = list(range(1, n + 1)), list(range(-1, n - 1)), symbols[:]
        leaves.append(NONE)  # the last symbol has no right neighbour

        while (root := min(top)) < NONE:
            i = root % n
            j = after[i]
            symbols[i] = merged = pairs((symbols[i], symbols[j]))[1]
            after[i] = k = after[j]
            leaves[j] = leaves[i] = NONE
            if k < n:
                before[k] = i
                if (found := pairs((merged, symbols[k]))) is not None:
                    leaves[i] = found[0] * n + i
            if (p := before[i]) >= 0:
                found = pairs((symbols[p], merged))
                leaves[p] = NONE if found is None else found[0] * n + p
            if len(levels) > 1:
                for leaf in (j, i, p) if p >= 0 else (j, i):
                    for low, high in zip(levels, levels[1:]):
                        leaf //= FAN
                        if leaf >= len(high) or high[leaf] == (least := min(low[leaf * FAN : leaf * FAN + FAN])):
                            break
                        high[leaf] = least
        out, i = [], 0
        while i < n:
            out.append(symbols[i])
            i = after[i]
        return out

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            data = word.encode("utf-8", "surrogatepass")
            symbols = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
            found = np.array(self.merge([s for s in symbols if s >= 0]), np.int32).tobytes()
            if len(self.words) >= CACHE:
                self.words.clear()
            if len(word) <= 64:
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space, as the bytes of int32."""
        found = self.chunks.get(chunk)
        if found is None:
            low = unicodedata.normalize("NFC", chunk)
            # lower case character by character: the final form of sigma needs context
            low = low.replace("Σ", "σ").lower()
            found = b"".join(map(self.word, self.word_re.findall(low)))
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            if len(chunk) <= 64:
                self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text."""
        if not any(x in text for x in self.special):
            return np.frombuffer(self._plain(text), np.int32)
        parts, at = [], 0
        for m in self.special_re.finditer(text):
            parts += [self._plain(text[at : m.start()]), np.int32(self.special[m[0]]).tobytes()]
            at = m.end()
        parts.append(self._plain(text[at:]))
        return np.frombuffer(b"".join(parts), np.int32)

    def _plain(self, text: str) -> bytes:
        # str.split() also cuts at \x1c-\x1f, which aren't white space to the vocabulary
        chunks = regex.split(r"\p{White_Space}+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        known = self.chunks.get
        return b"".join([known(c) or self.chunk(c) for c in chunks if c])

    def decode(self, ids: np.ndarray) -> str:
        """The pieces of ids, special ones too, joined by one space: the file names no decoder."""
        return " ".join(map(self.pieces.__getitem__, ids.tolist()))


_MODELS: dict[str, SegmentTreeBpe] = {}
#: Seconds after a task until a worker without another one gives its caches' memory back.
IDLE = 2.0
_timer: threading.Timer | None = None


def _in_use() -> None:
    if _timer is not None:
        _timer.cancel()


def _release_when_idle() -> None:
    """Workers outlive their tasks; what they cached must not add to the memory of later stages."""
    global _timer

    def clear() -> None:
        give_back(*(cache for model in _MODELS.values() for cache in (model.words, model.chunks)))

    _in_use()
    _timer = threading.Timer(IDLE, clear)
    _timer.daemon = True
    _timer.start()


def model_for(path: str) -> SegmentTreeBpe:
    """One model per worker and file."""
    if path not in _MODELS:
        _MODELS[path] = SegmentTreeBpe(path)
    return _MODELS[path]


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """(id, ids array<int>), with ``decoded`` string if ``round_trip``. No shuffle: each row is encoded where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _in_use()
        bpe = model_for(vocab_path)
        try:
            for batch in sliced(batches):
                ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
                columns = [batch.column(0), _lists(ids)]
                if round_trip:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])
        finally:
            _release_when_idle()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * round_trip)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): ids turned into pieces joined by one space; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model_for(vocab_path)
        for batch in sliced(batches):
            texts = [bpe.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
