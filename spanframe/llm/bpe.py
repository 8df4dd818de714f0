"""Token ids of a corpus under a public byte-level BPE tokenizer.

Merging uses a rank queue: one bucket of linked-list positions per merge rank and a three-level bitmap over the buckets.
Find-first-set gives the lowest rank that waits; its bucket is taken whole, in text order; entries whose pair is gone are
skipped. A push or pop costs a few machine words, independent of the pre-token's length, so a pre-token of n bytes
costs O(n) queue operations: very long words don't turn quadratic.

The text is cut into pre-tokens by the tokenizer's pattern. Texts without adjacent white space can be cut at spaces
and line ends first, since a pre-token boundary lies before every single space and around every single line end; the
ids of such parts are kept in a bounded table per worker, which saves time and never changes a result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanframe.llm.batches import slices

#: The pre-token pattern of the byte-level tokenizers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the table of known parts, per worker; it is emptied when full.
MEMO_ENTRIES = 200_000
_WIDTH = 64


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest is shifted."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(shifted)) for b in range(256)]


class Vocabulary:
    """Byte ids, and for each pair of ids its merge rank and the merged id. Small (some MB), whatever the corpus."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        if model.get("type") != "BPE":
            raise ValueError(f"{path}: a byte-level BPE vocabulary is needed, this is {model.get('type')}")
        ids = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte_ids = [ids[s] for s in byte_symbols()]
        self.rank = {(ids[a] << 32) | ids[b]: r for r, (a, b) in enumerate(merges)}
        self.merged = [ids[a + b] for a, b in merges]


class RankQueue:
    """Buckets of positions by merge rank under a three-level bitmap."""

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        low = ranks // _WIDTH + 1
        mid = low // _WIDTH + 1
        self.low, self.mid, self.top = [0] * low, [0] * mid, 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            word = rank >> 6
            self.low[word] |= 1 << (rank & 63)
            self.mid[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)
        bucket.append(position)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest waiting rank and its positions in order; None when nothing waits."""
        top = self.top
        if not top:
            return None
        block = (top & -top).bit_length() - 1
        mid = self.mid[block]
        word = (block << 6) + (mid & -mid).bit_length() - 1
        low = self.low[word]
        rank = (word << 6) + (low & -low).bit_length() - 1
        self.low[word] = low = low & (low - 1)
        if not low:
            self.mid[block] = mid = mid & (mid - 1)
            if not mid:
                self.top = top & (top - 1)
        positions = self.buckets[rank]
        self.buckets[rank] = []
        positions.sort()
        return rank, positions


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN, memo_entries: int = MEMO_ENTRIES) -> None:
        self.byte_ids, self.rank, self.merged = vocabulary.byte_ids, vocabulary.rank, vocabulary.merged
        self.queue = RankQueue(len(self.merged))
        self.pretokens = regex.compile(pattern).findall
        self.adjacent = re.compile(r"\s\s").search
        self.tokens, self.plain, self.spaced = _Memo(self._token, memo_entries), _Memo(self._part, memo_entries), _Memo(self._after_space, memo_entries)
        self.line_end = self._part("\n")

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.byte_ids[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank_of, merged, queue = self.rank.get, self.merged, self.queue
        push = queue.push
        for i in range(n - 1):
            r = rank_of((ids[i] << 32) | ids[i + 1])
            if r is not None:
                push(r, i)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (found := queue.pop()) is not None:
            rank, positions = found
            new = merged[rank]
            for i in positions:
                left = ids[i]
                j = after[i]
                # a position may be gone, at the end, or hold another pair by now
                if left < 0 or j >= n or rank_of((left << 32) | ids[j]) != rank:
                    continue
                ids[i], ids[j] = new, -1
                k = after[j]
                after[i] = k
                if k < n:
                    before[k] = i
                    r = rank_of((new << 32) | ids[k])
                    if r is not None:
                        push(r, i)
                h = before[i]
                if h >= 0:
                    r = rank_of((ids[h] << 32) | new)
                    if r is not None:
                        push(r, h)
        return [x for x in ids if x >= 0]

    def _token(self, pretoken: str) -> bytes:
        return np.array(self.merge(pretoken.encode("utf-8", "surrogatepass")), np.int32).tobytes()

    def _part(self, part: str) -> bytes:
        return b"".join([self.tokens[t] for t in self.pretokens(part)])

    def _after_space(self, part: str) -> bytes:
        return self._part(" " + part)

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        if self.adjacent(text):
            return self._part(text)
        spaced, plain = self.spaced, self.plain
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(plain[first] + b"".join([spaced[p] for p in rest]) if rest else plain[first])
        return self.line_end.join(lines)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()


class _Memo(dict):
    """Results by key, computed when missing; emptied at ``entries``. Long keys aren't kept."""

    def __init__(self, compute, entries: int) -> None:
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key: str) -> bytes:
        value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, vocabulary: Vocabulary, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary, kept between tasks."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, pattern)
    return _ENCODERS[key]


def encode_texts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids", pattern: str = PATTERN) -> DataFrame:
    """``id_col`` and the token ids of ``text_col`` under the tokenizer file ``tokenizer``, one row per input row.

    No special tokens are added; strings that look like them are ordinary text. Null and empty texts give the empty list. Texts of any length are
    encoded whole. Other columns are dropped, so their names can't clash. Rows keep their multiplicity; null ids stay
    null. One narrow pass, no shuffle; the vocabulary (a few MB, fixed) is read once on the driver and broadcast.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer + pattern, shared.value, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            # at most some MB of text at a time, so that long texts don't pile up
            for lo, hi in slices(texts):
                parts = [encoder.encode_bytes(t) if t else b"" for t in texts.slice(lo, hi - lo).to_pylist()]
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), values)], [id_col, out_col])

    schema = T.StructType([df.schema[id_col], T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)
