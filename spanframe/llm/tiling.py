"""Evaluation passages inside training texts, by greedy string tiling.

Texts become arrays of 64-bit word codes on the JVM. A rolling Karp-Rabin hash over windows of ``seed`` codes, computed for a whole batch at
once, is looked up in a bit table of the passages' windows; only documents with hits go on. Their hits are joined with the passages' windows,
which gives the pairs to look at, and each pair is tiled: the longest common run of unmarked words is marked first, then the next, down to
``min_tile`` words, so that passages whose parts were reordered still show their coverage.

One pass over the documents serves any number of passages: the bit table has a fixed size (a fuller one only lets more documents through to
the join, which is exact), passages are never collected, and of a document without hits nothing is kept. The result is as large as the leaks.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.functions.text import match_words
from spanframe.session import stored

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Size of the bit table: 2^24 bits, 2 MB, whatever the number of passages.
TABLE_BITS = 24
_SHIFT = np.uint64(64 - TABLE_BITS)


def word_codes(text: Column | str) -> Column:
    """The 64-bit codes of a text's match words, in order."""
    return F.transform(match_words(text), lambda w: F.xxhash64(w))


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """The polynomial hash, modulo 2^64, of every window of ``width`` numbers: Karp-Rabin's, for all starts at once."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    ids = ids.astype(np.uint64)
    out = ids[:n].copy()
    for j in range(1, width):
        out *= _BASE
        out += ids[j : j + n]
    # codes are hashes, sums of them too; the last step spreads what equal words leave in the low bits
    return (out ^ (out >> np.uint64(29))) * _BASE


def tile(item: np.ndarray, doc: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length) of the tiles, the longest first.

    Ties go to the earlier place in the passage, then in the document. Words that belong to a tile belong to no other.
    """
    n = len(item)
    if n < min_tile or len(doc) < min_tile:
        return []
    starts: dict[int, list[int]] = defaultdict(list)
    for i, h in enumerate(window_hashes(item, min_tile).tolist()):
        starts[h].append(i)
    hashes = window_hashes(doc, min_tile)
    places = np.flatnonzero(np.isin(hashes, np.array(list(starts), np.uint64)))
    a, b = item.tolist(), doc.tolist()
    runs = []
    ends: dict[int, int] = {}  # by diagonal: where the last run ended, so that each maximal run is found once
    for j in places.tolist():
        for i in starts[int(hashes[j])]:
            if ends.get(j - i, -1) > j:
                continue
            k = 0
            while i + k < n and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            ends[j - i] = j + k
            if k >= min_tile:
                runs.append((-k, i, j))
    heapq.heapify(runs)
    used_a, used_b = np.zeros(n, bool), np.zeros(len(b), bool)
    tiles = []
    while runs:
        k, i, j = heapq.heappop(runs)
        k = -k
        taken = used_a[i : i + k] | used_b[j : j + k]
        if not taken.any():
            tiles.append((i, j, k))
            used_a[i : i + k] = True
            used_b[j : j + k] = True
            continue
        # what is left of the run between marked words goes back
        free = np.flatnonzero(np.diff(np.concatenate(([1], taken.astype(np.int8), [1]))))
        for lo, hi in zip(free[::2].tolist(), free[1::2].tolist(), strict=True):
            if hi - lo >= min_tile:
                heapq.heappush(runs, (lo - hi, i + lo, j + lo))
    return tiles


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a list column without nulls."""
    return np.asarray(column.flatten()), np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(column)).astype(np.int64))))


def _inner_windows(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owners) of the windows of ``width`` values that lie within one list."""
    hashes = window_hashes(values, width)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = owner[: len(hashes)] == owner[width - 1 :] if len(hashes) else np.zeros(0, bool)
    return hashes[inside], owner[: len(hashes)][inside]


def item_windows(items: DataFrame, seed: int) -> DataFrame:
    """``passage, window, m``: the window hashes of each passage and at how many of its places each stands; ``items`` has ``passage, codes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owner = _inner_windows(*_lists(batch.column(1)), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(hashes.astype(np.int64))], ["passage", "window"])

    return items.select("passage", "codes").mapInArrow(run, T.StructType([items.schema["passage"], T.StructField("window", T.LongType())])).groupBy("passage", "window").agg(F.count("*").alias("m"))


def bit_table(windows: DataFrame) -> np.ndarray:
    """The table of 2^:data:`TABLE_BITS` bits that has the windows' bits set, merged as words of 64 bits: at most 2^18 rows reach the driver."""
    words = windows.select(F.shiftrightunsigned("window", 64 - TABLE_BITS).alias("b")).select(F.shiftright("b", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int")).alias("m"))
    merged = words.groupBy("w").agg(F.bit_or("m").alias("m"))
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    for batch in merged.toArrow().to_batches():
        table[np.asarray(batch.column(0))] = np.asarray(batch.column(1)).astype(np.uint64)
    return np.unpackbits(table.view(np.uint8), bitorder="little")


def candidate_documents(docs: DataFrame, table: np.ndarray, seed: int) -> DataFrame:
    """``doc, codes, windows``: the documents with windows whose bit is set, and these windows; ``docs`` has ``doc, codes``."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))
    number = T.ArrayType(T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            hashes, owner = _inner_windows(*_lists(batch.column(1)), seed)
            hit = bits[(hashes >> _SHIFT).astype(np.int64)]
            if hit.any():
                hashes, owner = hashes[hit], owner[hit]
                with_hits, first = np.unique(owner, return_index=True)
                windows = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), pa.array(hashes.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(with_hits)) for c in batch.columns), windows], ["doc", "codes", "windows"])

    return docs.select("doc", "codes").mapInArrow(run, T.StructType([docs.schema["doc"], T.StructField("codes", number), T.StructField("windows", number)]))


def _tiled(min_tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, at_a), (b, at_b) = (_lists(batch.column(i)) for i in (2, 3))
            rows = []
            for i in range(batch.num_rows):
                item = a[at_a[i] : at_a[i + 1]]
                tiles = tile(item, b[at_b[i] : at_b[i + 1]], min_tile)
                rows.append((len(item), tiles[0][2] if tiles else 0, sum(t[2] for t in tiles), len(tiles)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([r[k] for r in rows], pa.int32()) for k in range(4))], [*batch.schema.names[:2], "n_words", "longest", "covered", "tiles"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, seed: int = 6, min_tile: int = 4, least: int = 6, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", share: float | None = None, run: int = 8) -> DataFrame:
    """Documents that contain passages: ``doc_id, item_id, n_words, longest, covered, tiles``, one row per pair.

    A pair comes out if document and passage share ``seed`` consecutive match words; ``longest`` is the longest common run,
    ``covered`` the words of the passage in tiles of at least ``min_tile`` words, ``n_words`` its length. Passages
    shorter than ``least`` match words give no rows; null and empty texts and null ids give none; repeated documents or passages (same
    id and text) give one row; with several texts under one id each is tiled by itself and the greatest figures count. Texts of any length are
    read whole. Extra columns are ignored. Empty tables give the empty result. Words are compared through 64-bit codes.

    With ``share``, pairs that have too few common windows for tiles over this share of the passage, and for a run of ``run`` words, aren't tiled.
    No pair that reaches either is left out if ``seed`` is ``min_tile``: a tile of k words has k - seed + 1 windows, so k at most ``seed`` for each.
    """
    if not 0 < min_tile <= seed <= least:
        raise ValueError("min_tile, seed and least must not decrease")
    if share is not None and seed != min_tile:
        raise ValueError("a share needs seeds of min_tile words")
    if not isinstance(docs.schema[text].dataType, T.StringType):
        raise ValueError(f"{text} must be text")
    passages = items.filter(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), word_codes(text).alias("codes")).filter(F.size("codes") >= least).distinct()
    passages = stored(passages.withColumn("passage", F.xxhash64("item", "codes")))
    windows = stored(item_windows(passages, seed))
    texts = docs.filter(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), word_codes(text).alias("codes"))
    # codes of documents with hits only; a document's number tells its texts apart
    hits = stored(candidate_documents(texts, bit_table(windows), seed).withColumn("number", F.xxhash64("doc", "codes")))
    each = hits.select("number", F.explode(F.array_distinct("windows")).alias("window"))
    pairs = each.join(windows, "window").groupBy("number", "passage").agg(F.sum("m").alias("common"))
    bodies = hits.select("number", "doc", F.col("codes").alias("doc_codes")).dropDuplicates(["number"])
    both = pairs.join(passages.select("passage", "item", F.col("codes").alias("item_codes")), "passage")
    if share is not None:
        both = both.filter((F.col("common") * seed >= F.size("item_codes") * share) | (F.col("common") > run - seed))
    both = both.join(bodies, "number").select("doc", "item", "item_codes", "doc_codes")
    types = [T.StructField("doc", docs.schema[doc_id].dataType), T.StructField("item", items.schema[item_id].dataType), *(T.StructField(c, T.IntegerType()) for c in ("n_words", "longest", "covered", "tiles"))]
    found = both.mapInArrow(_tiled(min_tile), T.StructType(types)).filter("tiles > 0")
    return found.groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(*(F.max(c).alias(c) for c in ("n_words", "longest", "covered", "tiles")))


def qualifying(leaks: DataFrame, words: int = 8, shortest: int = 6) -> DataFrame:
    """The pairs whose longest run has ``words`` words, or all of a passage of ``shortest`` words to ``words`` less one."""
    return leaks.filter((F.col("n_words") >= shortest) & (F.col("longest") >= F.least(F.lit(words), F.col("n_words"))))


def covering(leaks: DataFrame, share: float = 0.5, words: int = 8) -> DataFrame:
    """The pairs whose tiles cover ``share`` of the passage, in whatever order, or that have a run of ``words`` words, with ``coverage``."""
    return leaks.withColumn("coverage", F.col("covered") / F.col("n_words")).filter((F.col("coverage") >= share) | (F.col("longest") >= words))
