"""Word and entity tables of a test set, and error and recall strata over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions import tags
from spanframe.operators import spans as S

#: Cells with fewer words or entities are left out of the strata.
LEAST_CELL = 30


def training_entities(train: DataFrame, keys: list[str]) -> DataFrame:
    """``text, etype, n``: the gold entities of training sentences by surface text and type."""
    return entity_texts(train, keys).groupBy("text", "etype").agg(F.count("*").alias("n"))


def entity_texts(words: DataFrame, keys: list[str], extra: list | None = None) -> DataFrame:
    """Gold spans with the text of their words, joined by one space, in the pass that finds the spans."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda s: s["word"]), " ").alias("text")
    return S.side_spans(words, keys, {"gold": "gold"}, [text, *(extra or [])]).drop("side")


def word_table(words: DataFrame, pieces: DataFrame, train: DataFrame) -> DataFrame:
    """Each word with pieces, characters, frequency in training, type and bins.

    ``words``: ``sentence_id, word_idx, word, gold``; ``pieces``: ``word, n_pieces, any_unk``; ``train`` has ``word``.
    """
    freq = train.groupBy("word").agg(F.count("*").alias("freq"))
    joined = words.join(pieces.select("word", "n_pieces", "any_unk"), "word").join(freq, "word", "left")
    joined = joined.withColumn("freq", F.coalesce("freq", F.lit(0).cast("long")))
    return joined.select(
        "sentence_id",
        "word_idx",
        "word",
        "gold",
        F.col("n_pieces").alias("pieces"),
        F.col("any_unk").alias("unk"),
        F.length("word").alias("chars"),
        "freq",
        tags.tag_type("gold").alias("etype"),
        (F.col("gold") != tags.OUTSIDE).alias("is_entity"),
        F.col("gold").startswith("B-").alias("is_begin"),
        tags.piece_bin("n_pieces").alias("piece_bin"),
        tags.frequency_bin("freq").alias("freq_bin"),
    )


def entity_table(words: DataFrame, pieces: DataFrame, train_entities: DataFrame) -> DataFrame:
    """Each gold entity with text, words, mean and most pieces, unknowns, whether training has it (same text, same type) and its bin.

    The mean is over the entity's words. Pieces are joined to words before spans are built: one window pass makes both.
    """
    joined = words.select("sentence_id", "word_idx", "word", "gold").join(pieces.select("word", "n_pieces", "any_unk"), "word")
    found = entity_texts(
        joined, ["sentence_id"], [F.count("*").cast("int").alias("n_words"), F.avg("n_pieces").alias("mean_pieces"), F.max("n_pieces").alias("max_pieces"), F.max("any_unk").alias("has_unk")]
    )
    seen = train_entities.select("text", "etype").withColumn("seen", F.lit(True))
    return found.join(seen, ["text", "etype"], "left").select(
        "sentence_id", "start", "end", "etype", "text", "n_words", "mean_pieces", "max_pieces", "has_unk", F.coalesce("seen", F.lit(False)).alias("seen"), tags.fertility_bin("mean_pieces").alias("fertility_bin")
    )


def run_strata(rows: DataFrame, run: str, by: list[str], value: str, group: list[str] | None = None, least: int = 0) -> DataFrame:
    """Mean of a run's rate in each cell over the runs, its sample sd, and the cell's size, which is the largest a run has.

    Two levels: the rate per run and cell, then mean and sd over runs. Cells of fewer than ``least`` rows are left out.
    """
    group = group or []
    per_run = rows.groupBy(*group, run, *by).agg(F.avg(value).alias("rate"), F.count("*").alias("n"))
    out = per_run.groupBy(*group, *by).agg(F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("sd"), F.max("n").alias("n"), F.count("*").alias("runs"))
    return out.filter(F.col("n") >= least) if least else out


def all_bins(found: DataFrame, column: str, bins: tuple[str, ...]) -> DataFrame:
    """``found`` with a row for every bin: what has no rows comes with ``n`` 0 and nulls."""
    every = found.sparkSession.createDataFrame([(b,) for b in bins], f"`{column}` string")
    return every.join(found, column, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def pivot_hits(hits: DataFrame, key: list[str], runs: list[str]) -> DataFrame:
    """One column ``hit_<run>`` per run: the shape of the entity file; only for a sink."""
    return hits.groupBy(*key).pivot("run_id", runs).agg(F.max("hit")).select(*key, *(F.col(f"`{r}`").alias(f"hit_{r}") for r in runs))
