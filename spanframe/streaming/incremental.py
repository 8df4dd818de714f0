"""Streaming forms: contract scores that add up, deduplication and windows with bounded state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanframe.functions import tags


def type_errors(stream: DataFrame, by: list[str]) -> DataFrame:
    """Words and errors by type, in update or complete mode: sums only, so the state is as large as the groups."""
    kind = tags.tag_type(F.coalesce("gold", F.lit(tags.OUTSIDE)))
    wrong = F.coalesce("gold", F.lit(tags.OUTSIDE)) != F.coalesce("pred", F.lit(tags.OUTSIDE))
    return stream.groupBy(*by, kind.alias("etype")).agg(F.count("*").alias("words"), F.count_if(wrong).alias("errors"))


def distinct_rows(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; repeats within ``delay`` are dropped and state older than it is forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` in event-time windows; late rows up to ``delay`` count."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = stream.withWatermark(time, delay).groupBy(window, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(rows: DataFrame, time: str, gap: str, by: str, delay: str | None = None) -> DataFrame:
    """Sessions of a key: runs of rows with no pause of ``gap`` or more; batch or stream (with ``delay``)."""
    df = rows.withWatermark(time, delay) if delay else rows
    grouped = df.groupBy(F.session_window(time, gap).alias("s"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def span_totals(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Span counts of each batch of whole sentences, handed to ``sink`` with the batch number: counts add up, so an idempotent
    sink keyed by batch gives exact scores."""
    from spanframe.operators.spans import sentence_counts

    def each(batch: DataFrame, number: int) -> None:
        counts = sentence_counts(batch.withColumns({c: F.coalesce(c, F.lit(tags.OUTSIDE)) for c in ("gold", "pred")}))
        sink(counts.groupBy("run_id").agg(*(F.sum(c).alias(c) for c in ("n_correct", "n_pred", "n_gold"))), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
