"""Entity spans of IOB2 tags and the scores built on them.

Gold and predicted spans come from one window pass over (run, sentence); the grouping that follows uses the same
partitioning, so the whole chain from words to matched spans costs the one shuffle that brought the sentences together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import tags
from spanframe.functions.tags import ratio

SENTENCE = ["run_id", "sentence_id"]
MICRO = "micro"


def side_spans(words: DataFrame, keys: list[str] | None = None, sides: dict[str, str] | None = None, extra: list[Column] | None = None) -> DataFrame:
    """``*keys, side, etype, start, end`` of every span; ``end`` is exclusive.

    ``sides`` names the tag column of each side. ``extra`` are aggregates over a span's words, computed in the same pass. ``words`` needs the keys and
    ``word_idx``.
    """
    keys = keys or SENTENCE
    sides = sides or {"gold": "gold", "pred": "pred"}
    order = Window.partitionBy(*keys).orderBy("word_idx")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = words.withColumns({f"_start_{s}": tags.starts_span(F.col(c), F.lag(c).over(order)).cast("int") for s, c in sides.items()})
    numbered = flagged.withColumns({f"_span_{s}": F.sum(f"_start_{s}").over(running) for s in sides})
    # words outside of all spans end here
    each = F.array_compact(F.array(*(F.when(F.col(c) != tags.OUTSIDE, F.struct(F.lit(s).alias("side"), tags.tag_type(c).alias("etype"), F.col(f"_span_{s}").alias("n"))) for s, c in sides.items())))
    long = numbered.withColumn("_x", F.explode(each)).drop(*(f"_{k}_{s}" for k in ("start", "span") for s in sides))
    grouped = long.groupBy(*keys, F.col("_x.side").alias("side"), F.col("_x.n").alias("_n"))
    aggregates = [F.first("_x.etype").alias("etype"), F.min("word_idx").alias("start"), (F.max("word_idx") + 1).alias("end"), *(extra or [])]
    return grouped.agg(*aggregates).drop("_n")


def matched_spans(words: DataFrame, keys: list[str] | None = None, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """``*keys, etype, start, end, in_gold, in_pred``: each distinct span once, with the sides that have it."""
    keys = keys or SENTENCE
    found = side_spans(words, keys, {"gold": gold, "pred": pred})
    return found.groupBy(*keys, "etype", "start", "end").agg(F.max(F.col("side") == "gold").alias("in_gold"), F.max(F.col("side") == "pred").alias("in_pred"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("in_gold") & F.col("in_pred")).alias("n_correct"), F.count_if("in_pred").alias("n_pred"), F.count_if("in_gold").alias("n_gold")]


def sentence_counts(words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``*keys, n_correct, n_pred, n_gold`` of every sentence, those without spans too: all that F1 and its resampling need."""
    keys = keys or SENTENCE
    counted = matched_spans(words, keys).groupBy(*keys).agg(*_counts())
    every = words.select(*keys).distinct()
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_correct", "n_pred", "n_gold")}
    return every.join(counted, keys, "left").withColumns(zero)


def scores(correct: Column, predicted: Column, gold: Column) -> dict[str, Column]:
    """Precision, recall and F1 from counts; 0 where undefined."""
    return {"precision": ratio(correct, predicted), "recall": ratio(correct, gold), "f1": ratio(2 * correct, predicted + gold)}


def prf(words: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 by type and over all (``etype`` ``micro``), for each value of ``by``, columns of ``words`` that don't vary within a sentence of a run.

    ``support`` is the number of gold spans; types that only predictions have come with support 0. A group without any
    span has no rows.
    """
    by = by or []
    keys = [*SENTENCE, *(b for b in by if b not in SENTENCE)]
    per_type = matched_spans(words, keys).groupBy(*by, "etype").agg(*_counts())
    # all types together from the few rows by type: one pass over the spans gives both levels
    levels = per_type.withColumn("etype", F.explode(F.array("etype", F.lit(MICRO))))
    both = levels.groupBy(*by, "etype").agg(*(F.sum(c).alias(c) for c in ("n_correct", "n_pred", "n_gold")))
    return both.select(*by, "etype", F.col("n_gold").alias("support"), "n_pred", "n_correct", *(v.alias(k) for k, v in scores(F.col("n_correct"), F.col("n_pred"), F.col("n_gold")).items()))


def token_accuracy(words: DataFrame, by: list[str]) -> DataFrame:
    """Sentences, words, truncated words and the share of right tags."""
    return words.groupBy(*by).agg(
        F.count_distinct("sentence_id").alias("sentences"),
        F.count("*").alias("words"),
        F.count_if("truncated").alias("truncated_words"),
        ratio(F.count_if(F.col("gold") == F.col("pred")), F.count("*")).alias("accuracy"),
    )


def evaluate(words: DataFrame, by: str = "run_id") -> DataFrame:
    """One row per run: micro scores, counts of spans, accuracy and word counts. Runs without spans score 0."""
    micro = prf(words, [by]).filter(F.col("etype") == MICRO).select(by, "precision", "recall", "f1", F.col("support").alias("gold_spans"), F.col("n_pred").alias("pred_spans"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("precision", "recall", "f1")} | {c: F.coalesce(c, F.lit(0)) for c in ("gold_spans", "pred_spans")}
    return token_accuracy(words, [by]).join(micro, by, "left").withColumns(zero)
