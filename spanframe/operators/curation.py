"""Curation of web text into lines: rules in fixed order, first-wins deduplication, decontamination, a word budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import text as X

#: The stages in their order; a line counts once, at the first rule it fails.
STAGES = ("too_short", "too_long", "not_kazakh", "duplicate", "contaminated", "kept")
MIN_WORDS, MAX_WORDS = 5, 500
INDEX_WORDS = 6


def document_lines(docs: DataFrame, order: list[str], doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, line_no, line``, then the ``order`` columns: normalised lines that aren't blank, in an explicit order."""
    # NFC once per text: no separator composes with what follows
    texts = docs.select(doc_id, *(c for c in order if c != doc_id), X.nfc("text").alias("text"))
    # lines leave the generator ready: a filter on them can't repeat their making
    ready = F.transform(X.split_lines("text"), lambda x: X.squeeze(x))
    return texts.select(*(c for c in texts.columns if c != "text"), F.posexplode(ready).alias("line_no", "line")).filter("line <> ''")


def line_rule(line: Column | str, script: Column | None = None, n_words: Column | None = None) -> Column:
    """The first rule by itself that a line fails, null if none: length band, then script."""
    n = X.word_count(line) if n_words is None else n_words
    in_script = X.is_kazakh(line) if script is None else script
    return F.when(n < MIN_WORDS, "too_short").when(n > MAX_WORDS, "too_long").when(~in_script, "not_kazakh")


def word_windows(words: Column, n: int) -> Column:
    """A hash of each window of ``n`` consecutive words; empty for shorter arrays."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, n)))


def containing(rows: DataFrame, index: DataFrame, key: list[str], text: str, index_text: str, n: int = INDEX_WORDS) -> DataFrame:
    """The distinct ``key`` of rows whose words contain all words of some indexed text in a row.

    Indexed texts of fewer than ``n`` words are left out. An equi-join on the hash of the first ``n`` words of the indexed text against the
    word windows of the rows proposes pairs, which are verified word by word; there is no product of rows and texts. Spark
    broadcasts the index where it is small, and else shuffles hashes.
    """
    indexed = index.select(X.folded_words(index_text).alias("iw")).filter(F.size("iw") >= n).distinct()
    indexed = indexed.withColumn("head", F.xxhash64(F.slice("iw", 1, n)))
    w = rows.select(*key, X.folded_words(text).alias("w")).filter(F.size("w") >= n)
    windows = w.select(*key, "w", F.posexplode(word_windows(F.col("w"), n)).alias("at", "head"))
    hit = windows.join(indexed, "head").filter(F.slice(F.col("w"), F.col("at") + 1, F.size("iw")) == F.col("iw"))
    return hit.select(*key).distinct()


def line_stages(lines: DataFrame, order: list[str], index: DataFrame | None = None, index_text: str = "text", script: Column | None = None) -> DataFrame:
    """``*order, n_words, stage`` of every line, without its text. ``order`` names the columns that order all lines and give each a place of its own; the first of equal lines wins.

    Only lines that pass the rules by themselves take part in deduplication, and a first copy that is later dropped as contaminated still
    makes the others duplicates. Equal lines are found by a 128-bit hash. One pass over the text writes places, rules and hashes, which is all that
    deduplication and the stages move; with an index a second pass looks for its texts.
    """
    from spanframe.session import stored

    ruled = lines.select(*order, "line", X.word_count("line").alias("n_words")).withColumn("rule", line_rule("line", script, F.col("n_words")))
    hashes = {"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), F.reverse("line"))}
    slim = stored(ruled.select(*order, "n_words", "rule", *(F.when(F.col("rule").isNull(), x).alias(c) for c, x in hashes.items())))
    # the first of equal lines by a partial minimum: no group of copies is ever collected or sorted
    first = slim.filter("rule is null").groupBy("h", "g").agg(F.min(F.struct(*order)).alias("first"))
    judged = first.select("first.*", F.lit("kept").alias("_judged"))
    if index is not None:
        bad = containing(ruled.filter("rule is null"), index, order, "line", index_text).withColumn("_bad", F.lit("contaminated"))
        judged = judged.join(bad, order, "left").select(*order, F.coalesce("_bad", "_judged").alias("_judged"))
    # joined back on the lines' places, which are unique and short
    return slim.join(judged, order, "left").select(*order, "n_words", F.coalesce("rule", "_judged", F.lit("duplicate")).alias("stage"))


def staged_lines(lines: DataFrame, order: list[str], index: DataFrame | None = None, index_text: str = "text", script: Column | None = None, only: str | None = None) -> DataFrame:
    """``lines`` with ``n_words`` and ``stage`` (:func:`line_stages`); with ``only`` the lines of one stage, whose places are chosen before any text is joined."""
    stages = line_stages(lines, order, index, index_text, script)
    return lines.join(stages if only is None else stages.filter(F.col("stage") == only), order)


def prefix_sums(df: DataFrame, value: str, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before, in the order of ``order``; null counts as 0.

    Two levels, never one partition: a range partitioning by the order, a sum within each partition, and the partitions' totals
    (one row each) added up and joined back.
    """
    n = partitions or max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    from spanframe.session import stored

    # ranges are found by sampling: cut here, so that totals and rows see the same partitions
    ranged = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_t"))
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(offsets), "_part")
    return summed.withColumn(out, F.col("_before") + F.col("_in")).drop("_part", "_before", "_in")


def until_budget(staged: DataFrame, target_words: int, order: list[str]) -> DataFrame:
    """The lines up to the word budget: the kept line that reaches it is the last; lines after it belong to no stage."""
    counted = staged.withColumn("_words", F.when(F.col("stage") == "kept", F.col("n_words")).otherwise(0).cast("long"))
    return prefix_sums(counted, "_words", order, "words_before").filter(F.col("words_before") < target_words).drop("_words")


def stage_counts(staged: DataFrame) -> DataFrame:
    """``stage, lines, words`` with ``lines`` for all lines together."""
    counted = staged.groupBy("stage").agg(F.count("*").alias("lines"), F.sum(F.col("n_words").cast("long")).alias("words"))
    # all lines together, from the few rows by stage
    levels = counted.withColumn("stage", F.explode(F.array("stage", F.lit("lines"))))
    return levels.groupBy("stage").agg(F.sum("lines").alias("lines"), F.sum("words").alias("words"))


def seeded_group_order(groups: DataFrame, seed: int) -> DataFrame:
    """``file_name, row_group, rank``: a fixed random order of the row groups, drawn on the driver (one row per row group)."""
    import numpy as np

    listed = [(r[0], r[1]) for r in groups.select("file_name", "row_group").distinct().orderBy("file_name", "row_group").collect()]
    order = np.random.default_rng(seed).permutation(len(listed))
    return groups.sparkSession.createDataFrame([(*listed[i], rank) for rank, i in enumerate(order.tolist())], "file_name string, row_group int, rank int")


def manifest_digest(kept: DataFrame) -> DataFrame:
    """Lines, words and an order-free digest of the kept lines."""
    return kept.agg(F.count("*").alias("lines"), F.sum(X.word_count("line")).alias("words"), F.bit_xor(F.xxhash64("line")).alias("digest"))


def write_corpus(kept: DataFrame, path: str, order: list[str]) -> None:
    """Write the kept lines as text in order; files are ranges of the order, so that their names give the whole order."""
    kept.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("line").alias("value")).write.mode("overwrite").text(path)
