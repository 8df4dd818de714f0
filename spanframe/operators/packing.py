"""Consecutive words of a whole text packed greedily into chunks, in parallel and exactly.

Where a chunk ends depends on where it began, so packing is sequential; but what one range of the text does to the packing depends only on how full
the open chunk is when the range begins, a number from 0 to the budget. Each range is read once for all these numbers together (they soon agree),
the ranges' results are chained (one small row per range), and a second pass cuts every range with the state it really begins with. Only chunks that
cross a range's bounds are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.session import stored

_PART = "_part"


def _ranges(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def transfer(sizes: Iterator[int], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(fill at the end, chunks closed) of a range of word sizes, for an open chunk filled with 0 to ``budget`` pieces at its start.

    A word above the budget fills its chunk: what follows opens a new one.
    """
    used, closed = np.arange(budget + 1), np.zeros(budget + 1, np.int64)
    sizes = iter(sizes)
    for i, size in enumerate(sizes):
        size = min(size, budget)
        over = (used > 0) & (used + size > budget)
        closed += over
        used = np.where(over, size, used + size)
        if i % 32 == 31 and (used == used[0]).all():
            break
    fill, more = int(used[0]), 0
    for size in sizes:  # all states agree from here on
        size = min(size, budget)
        if fill + size > budget:
            more, fill = more + 1, size
        else:
            fill += size
        used[:] = fill
    return used, closed + more


def _sizes(batches: Iterator[pa.RecordBatch], parts: list) -> Iterator[int]:
    for batch in batches:
        if batch.num_rows:
            parts[:] = [batch.column(0)[0].as_py()]
        yield from batch.column(1).flatten().to_pylist()


def packed_text(lines: DataFrame, order: list[str], words: str, sizes: str, budget: int, max_chunks: int | None = None) -> DataFrame:
    """``chunk, words, pieces, oversized, closed_by_oversized``: the text's words in chunks of at most ``budget`` pieces, numbered from 0.

    ``lines`` has the ``order`` columns, which give every line a place of its own, ``words array<string>`` and their ``sizes array<int>`` (1 at least).
    Chunks run on from line to line. A word above the budget is a chunk by itself and counted as ``oversized``; ``closed_by_oversized`` tells that
    the word after the chunk is one. Of ``max_chunks`` chunks the first are kept. Null and empty lines add nothing; an empty table gives no rows.
    """
    if budget < 1:
        raise ValueError("a chunk must have room for a piece")
    n = _ranges(lines)
    kept = lines.select(*order, F.col(words).alias("_w"), F.transform(sizes, lambda x: F.greatest(x.cast("int"), F.lit(1))).alias("_s")).filter("size(_w) > 0")
    ranged = stored(kept.repartitionByRange(n, *order).withColumn(_PART, F.spark_partition_id()))
    placed = ranged.repartitionById(n, _PART).sortWithinPartitions(*order)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[int] = []
        used, closed = transfer(_sizes(batches, parts), budget)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([closed.tolist()], pa.list_(pa.int64()))], ["part", "used", "closed"])

    steps = placed.select(_PART, "_s").mapInArrow(chain, "part int, used array<int>, closed array<bigint>").collect()
    entries, fill, chunk = {}, 0, 0
    for step in sorted(steps, key=lambda r: r["part"]):
        entries[step["part"]] = (fill, chunk)
        fill, chunk = step["used"][fill], chunk + step["closed"][fill]
    last = chunk + 1 if max_chunks is None else max_chunks

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = ("chunk", "part", "whole", "words", "pieces", "oversized", "closed_by_oversized")
        types = (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.bool_())

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        part, used, number, own, pieces, oversized, began_here = None, 0, 0, [], 0, 0, True
        for batch in batches:
            for w, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part is None:
                    part = batch.column(0)[0].as_py()
                    used, number = entries[part]
                    began_here = used == 0
                if number >= last:
                    break
                for word, size in zip(w, s, strict=True):
                    fits = min(size, budget)
                    if used and used + fits > budget:
                        out.append((number, part, began_here, own, pieces, oversized, size > budget))
                        number, used, own, pieces, oversized, began_here = number + 1, 0, [], 0, 0, True
                        if number >= last:
                            break
                    own.append(word)
                    used, pieces, oversized = used + fits, pieces + size, oversized + (size > budget)
            if len(out) >= 10_000:
                yield flush()
        if own:
            out.append((number, part, False, own, pieces, oversized, False))
        if out:
            yield flush()

    schema = "chunk bigint, part int, whole boolean, words array<string>, pieces bigint, oversized int, closed_by_oversized boolean"
    cuts = stored(placed.select(_PART, "_w", "_s").mapInArrow(cut, schema))
    columns = ("chunk", "words", "pieces", "oversized", "closed_by_oversized")
    # of a chunk that crosses ranges every range has a part; there are at most two of them per range
    parts = F.array_sort(F.collect_list(F.struct("part", "words")))
    crossing = cuts.filter("not whole").groupBy("chunk").agg(F.flatten(F.transform(parts, lambda x: x["words"])).alias("words"), F.sum("pieces").alias("pieces"), F.sum("oversized").cast("int").alias("oversized"), F.max("closed_by_oversized").alias("closed_by_oversized"))
    return cuts.filter("whole").select(*columns).unionByName(crossing.select(*columns))


def packing_report(chunks: DataFrame, max_chunks: int | None = None) -> DataFrame:
    """``chunks, words, pieces, oversized``: one row; words above the budget that were read, the one that closed the last chunk of a limited packing too."""
    closing = F.lit(0) if max_chunks is None else F.sum(F.when((F.col("chunk") == max_chunks - 1) & F.col("closed_by_oversized"), 1).otherwise(0))
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("oversized") + closing, F.lit(0)).alias("oversized"))
