"""The prediction contract: one row per run and word; loading, validation, truncation, label mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import tags

KEY = ["run_id", "sentence_id", "word_idx"]


def latest(predictions: DataFrame, place: tuple[str, ...] = ("run_id", "sentence_id")) -> DataFrame:
    """The rows of the last load of each (run, sentence, word); missing tags are ``O``, a missing flag is false.

    Of rows with equal or missing load times the greatest by word, tags and flag counts, so that reruns agree.

    One shuffle by ``place`` serves this and everything by sentence that follows; a run that holds a third of all rows is
    spread over its sentences. Place by ``sentence_id`` alone where runs are brought together afterwards.
    """
    placed = predictions.repartition(*place)
    fields = ("word", "gold", "pred", "truncated")
    last = placed.groupBy(*KEY).agg(F.max(F.struct("loaded_at", *fields)).alias("x"))
    return last.select(
        *KEY,
        "x.word",
        F.coalesce("x.gold", F.lit(tags.OUTSIDE)).alias("gold"),
        F.coalesce("x.pred", F.lit(tags.OUTSIDE)).alias("pred"),
        F.coalesce("x.truncated", F.lit(False)).alias("truncated"),
    )


def violations(predictions: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Rules that rows break: ``run_id, sentence_id, word_idx, rule``; ``word_idx`` is null for rules of whole sentences.

    ``empty``: a missing or empty key, word, gold or pred; ``label``: a tag that isn't IOB2, or with ``labels`` (one
    column ``label``) isn't among them; ``duplicate``: the same word of a run twice; ``gap``: word indexes that
    aren't 0 to n - 1.
    """
    empty = F.exists(F.array(*(F.col(c).cast("string") for c in ("sentence_id", "word_idx", "word", "gold", "pred"))), lambda x: x.isNull() | (x == ""))
    found = [predictions.filter(empty).select(*KEY, F.lit("empty").alias("rule"))]
    each = predictions.select(*KEY, F.explode(F.array("gold", "pred")).alias("label")).filter("label is not null and label <> ''")
    unknown = each.filter(~tags.is_tag("label")) if labels is None else each.join(labels.select("label").distinct(), "label", "left_anti")
    found.append(unknown.select(*KEY).distinct().withColumn("rule", F.lit("label")))
    counted = predictions.groupBy(*KEY).agg(F.count("*").alias("n"))
    found.append(counted.filter("n > 1").select(*KEY, F.lit("duplicate").alias("rule")))
    bounds = counted.groupBy("run_id", "sentence_id").agg(F.min("word_idx").alias("lo"), F.max("word_idx").alias("hi"), F.count("*").alias("n"))
    found.append(bounds.filter("lo <> 0 or hi <> n - 1").select("run_id", "sentence_id", F.lit(None).cast("int").alias("word_idx"), F.lit("gap").alias("rule")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def restore_truncated(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """All gold words with their prediction; a word without one was cut off: ``O``, truncated.

    ``gold``: ``sentence_id, word_idx, word, gold``; ``predicted``: ``run_id, sentence_id, word_idx, pred`` of runs over these sentences. A
    run's cut words are found among the sentences it has rows for.
    """
    seen = predicted.select("run_id", "sentence_id").distinct()
    wanted = gold.join(seen, "sentence_id")
    joined = wanted.join(predicted.select(*KEY, "pred"), KEY, "left")
    return joined.select(*KEY, "word", "gold", F.coalesce("pred", F.lit(tags.OUTSIDE)).alias("pred"), F.col("pred").isNull().alias("truncated"))


def prefix_mismatches(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predicted words that aren't the gold word of their place: they may only be a prefix of the sentence."""
    g = gold.select("sentence_id", "word_idx", F.col("word").alias("gold_word"))
    return predicted.join(g, ["sentence_id", "word_idx"], "left").filter(F.col("gold_word").isNull() | (F.col("gold_word") != F.col("word"))).select(*KEY, "word", "gold_word")


def first_subword_predictions(subwords: DataFrame, words: DataFrame) -> DataFrame:
    """Word predictions from subword scores: the best label of each word's first subword; words without one are ``O``, truncated.

    ``subwords``: ``sentence_id, pos, word_id, scores array<double>, labels array<string>`` (``word_id`` null for special
    positions); ``words``: ``sentence_id, word_idx, word, gold``.
    """
    best = F.element_at("labels", F.array_position("scores", F.array_max("scores")).cast("int"))
    first = subwords.filter("word_id is not null").groupBy("sentence_id", F.col("word_id").alias("word_idx")).agg(F.min_by(best, "pos").alias("pred"))
    joined = words.join(first, ["sentence_id", "word_idx"], "left")
    return joined.select("sentence_id", "word_idx", "word", "gold", F.coalesce("pred", F.lit(tags.OUTSIDE)).alias("pred"), F.col("pred").isNull().alias("truncated"))


def fingerprints(contract: DataFrame, columns: tuple[str, ...] = ("word", "gold")) -> DataFrame:
    """``run_id, words, digest``: runs over the same ``columns`` at the same places have equal digests, in any row order."""
    row = F.xxhash64("sentence_id", "word_idx", *columns)
    return contract.groupBy("run_id").agg(F.count("*").alias("words"), F.bit_xor(row).alias("digest"))


def different_sets(contract: DataFrame, columns: tuple[str, ...] = ("word", "gold")) -> DataFrame:
    """``words, digest, runs``: the distinct test sets of runs that should share one, the most common first; one row if they do."""
    return fingerprints(contract, columns).groupBy("words", "digest").agg(F.array_sort(F.collect_list("run_id")).alias("runs")).orderBy(F.desc(F.size("runs")), "digest")


def require_same_set(contract: DataFrame, columns: tuple[str, ...] = ("word", "gold")) -> None:
    """An error that names runs whose test set differs from the others'."""
    found = different_sets(contract, columns).limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"runs with another test set: {', '.join(found[1]['runs'][:5])}")


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows that only one of two tables of equal columns has, with ``side`` ``left`` or ``right``: none if they are equal as sets."""
    sides = a.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(b.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    # one aggregation over both instead of two anti-joins
    found = sides.groupBy(*a.columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).filter("_a <> _b")
    return found.select(*a.columns, F.when(F.col("_a") == 1, "left").otherwise("right").alias("side"))


def require_common_targets(gold: dict[str, str] | None, pred: dict[str, str] | None) -> None:
    """Two mappings must end in the same types; of one mapping only, the other side's types are its targets."""
    if gold is not None and pred is not None and set(gold.values()) - {tags.OUTSIDE} != set(pred.values()) - {tags.OUTSIDE}:
        raise ValueError("the mappings of gold and predicted labels have different target types")


def labelled_positions(aligned: DataFrame, labels: list[str], key: str = "sentence_id") -> DataFrame:
    """``run_id, sentence_id, word_idx, word, gold, pred``: the positions of aligned rows that carry a label, as contract rows.

    ``aligned``: ``key, label_ids array<int>, pred_ids array<int>``; label -100 marks positions that don't count. This is a trainer's view of a
    test set: words that were cut off are missing from it, where the contract counts them as ``O``.
    """
    names = F.array(*(F.lit(x) for x in labels))
    each = aligned.select(F.col(key).alias("sentence_id"), F.posexplode(F.arrays_zip(F.col("label_ids").alias("g"), F.col("pred_ids").alias("p"))).alias("word_idx", "x")).filter("x.g <> -100")
    return each.select(F.lit("trainer").alias("run_id"), "sentence_id", "word_idx", F.lit("").alias("word"), F.element_at(names, F.col("x.g") + 1).alias("gold"), F.element_at(names, F.col("x.p") + 1).alias("pred"))


def unmapped_types(contract: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Types of gold or predicted tags that a mapping doesn't list."""
    types = contract.select(F.explode(F.array(tags.tag_type("gold"), tags.tag_type("pred"))).alias("etype")).filter("etype <> ''").distinct()
    known = contract.sparkSession.createDataFrame([(k,) for k in mapping] or [("",)], "etype string")
    return types.join(F.broadcast(known), "etype", "left_anti")


def label_ids(labels: DataFrame, column: str = "label") -> DataFrame:
    """``label, id``: distinct labels numbered from 0 in order; a handful of rows, whatever the input."""
    distinct = labels.select(F.col(column).alias("label")).filter("label is not null").distinct()
    return distinct.withColumn("id", F.row_number().over(Window.orderBy("label")) - 1)
