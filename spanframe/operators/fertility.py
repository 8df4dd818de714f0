"""Tokenizer analytics: fertility summaries, vocabulary overlap, candidates and usage of new pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions import wordpiece as WP
from spanframe.functions.tags import ratio


def word_counts(words: DataFrame, by: list[str], column: str = "word") -> DataFrame:
    """``*by, word, n``: all that the summaries need of a corpus, pre-aggregated before anything is tokenized."""
    return words.groupBy(*by, F.col(column).alias("word")).agg(F.count("*").alias("n"))


def fertility(counted: DataFrame, pieces: DataFrame, by: str) -> DataFrame:
    """Pieces per word by ``by`` and over all (null): words, pieces, mean, median, population sd, split and unknown rates.

    ``counted``: ``by, word, n``; ``pieces``: ``word, n_pieces, is_unk``. Works on the histogram of piece counts: the groups joined are as many as
    there are distinct words, and the final sort for the median as long as there are distinct piece counts.
    """
    histogram = counted.join(pieces.select("word", "n_pieces", "is_unk"), "word").groupBy(by, "n_pieces").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("is_unk"), F.col("n")).otherwise(0)).alias("unk"))
    p, n = F.col("n_pieces").cast("double"), F.col("n")
    total, pieces_sum = F.sum(n), F.sum(F.col("n_pieces") * n)
    split_words, split_pieces = F.sum(F.when(p > 1, n).otherwise(0)), F.sum(F.when(p > 1, F.col("n_pieces") * n).otherwise(0))
    mean = pieces_sum.cast("double") / total
    variance = F.sum(p * p * n) / total - mean * mean
    return histogram.rollup(by).agg(
        total.alias("words"),
        pieces_sum.alias("subwords"),
        mean.alias("mean"),
        F.sum(F.when(p == 1, n).otherwise(0)).alias("single_words"),
        split_words.alias("split_words"),
        ratio(split_words, total).alias("split_rate"),
        ratio(split_pieces, split_words).alias("mean_of_split"),
        F.percentile("n_pieces", 0.5, F.col("n")).alias("median"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sd"),
        F.max("n_pieces").alias("max_pieces"),
        F.sum("unk").alias("unknown"),
        ratio(F.sum("unk"), total).alias("unknown_rate"),
    )


def piece_overlap(source: DataFrame, target: DataFrame, tokenize: Callable[[Column | str], Column], unk: str = WP.UNK) -> DataFrame:
    """How much of a target corpus the pieces of a source corpus cover: one row.

    ``source`` and ``target`` have ``word``. The unknown piece is never shared but counts among the target's. Shares are null where
    there is nothing to share.
    """
    s, t = word_counts(source, []), word_counts(target, [])
    pieces = WP.piece_table(s.select("word").unionByName(t.select("word")), tokenize).select("word", "pieces")
    shared = s.join(pieces, "word").select(F.explode("pieces").alias("piece")).filter(F.col("piece") != unk).distinct().withColumn("shared", F.lit(True))
    known = s.select("word").withColumn("in_source", F.lit(True))
    words = t.join(pieces, "word").join(known, "word", "left")
    each = words.select("word", "n", F.explode("pieces").alias("piece")).join(shared, "piece", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    covered = each.groupBy("word").agg(F.bool_and("shared").alias("covered"))
    by_piece = each.groupBy("piece", "shared").agg(F.sum("n").alias("n"))
    types = by_piece.agg(
        F.count("*").alias("piece_types"),
        F.sum("n").alias("piece_tokens"),
        F.count_if("shared").alias("shared_piece_types"),
        F.coalesce(F.sum(F.when(F.col("shared"), F.col("n"))), F.lit(0)).alias("shared_piece_tokens"),
    )
    by_word = words.join(covered, "word").agg(
        F.sum("n").alias("words"),
        F.count("*").alias("word_types"),
        F.coalesce(F.sum(F.when(F.col("covered"), F.col("n"))), F.lit(0)).alias("covered_words"),
        F.count_if("in_source").alias("word_types_in_source"),
    )

    def percent(a: str, b: str) -> Column:
        return 100 * F.col(a).cast("double") / F.nullif(F.col(b).cast("double"), F.lit(0.0))

    # two one-row tables side by side
    both = by_word.withColumn("_k", F.lit(1)).join(types.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.select(
        "words",
        "word_types",
        "piece_tokens",
        "piece_types",
        percent("shared_piece_types", "piece_types").alias("shared_piece_types"),
        percent("shared_piece_tokens", "piece_tokens").alias("shared_piece_tokens"),
        percent("covered_words", "words").alias("covered_words"),
        percent("word_types_in_source", "word_types").alias("word_types_in_source"),
    )


def usage_counts(counted: DataFrame, pieces: DataFrame) -> DataFrame:
    """``piece, n``: how often each piece is used, from word counts."""
    return counted.join(pieces.select("word", "pieces"), "word").select("n", F.explode("pieces").alias("piece")).groupBy("piece").agg(F.sum("n").alias("n"))


def candidates(learned: DataFrame, base: DataFrame, usage: DataFrame, spellable: Callable[[Column | str], Column]) -> DataFrame:
    """``piece, n, skip``: learned pieces with their use and the first reason to skip them (null: a candidate).

    Reasons in order: ``in_base``, ``single_character``, ``needs_unk`` (the base vocabulary can't spell it), ``unused``.
    """
    known = base.select("piece").distinct().withColumn("known", F.lit(True))
    body = F.regexp_replace("piece", "^##", "")
    joined = learned.select("piece").distinct().join(known, "piece", "left").join(usage, "piece", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    skip = F.when(F.col("known"), "in_base").when(F.length(body) <= 1, "single_character").when(~spellable("piece"), "needs_unk").when(F.col("n") == 0, "unused")
    return joined.select("piece", "n", skip.alias("skip"))


def top_candidates(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` most used candidates, ties by piece: a bounded sort."""
    return found.filter("skip is null").orderBy(F.desc("n"), "piece").limit(n).select("piece", "n")


def piece_usage(new_pieces: DataFrame, usage: DataFrame) -> DataFrame:
    """Use of all new pieces, unused ones too: number, least, tenth percentile, median, below 100, unused."""
    used = new_pieces.select("piece").join(usage, "piece", "left").select(F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return used.agg(
        F.count("*").alias("pieces"), F.min("n").alias("least"), F.percentile("n", 0.1).alias("p10"), F.percentile("n", 0.5).alias("median"), F.count_if(F.col("n") < 100).alias("below_100"), F.count_if(F.col("n") == 0).alias("unused")
    )


def extension_report(words: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean pieces before and after an extension for all, entity, and fragmented entity words (four pieces or more before), with unknown shares.

    ``words``: ``word, is_entity, n``; ``before`` and ``after``: piece tables.
    """
    b = before.select("word", F.col("n_pieces").alias("b"), F.col("any_unk").alias("bu"))
    a = after.select("word", F.col("n_pieces").alias("a"), F.col("any_unk").alias("au"))
    joined = words.join(b, "word").join(a, "word")
    groups = F.array_compact(F.array(F.lit("all"), F.when(F.col("is_entity"), "entity"), F.when(F.col("is_entity") & (F.col("b") >= 4), "fragmented")))
    long = joined.withColumn("grp", F.explode(groups))

    def mean(c: Column) -> Column:
        return ratio(F.sum(c * F.col("n")), F.sum("n"))

    return long.groupBy("grp").agg(F.sum("n").alias("words"), mean(F.col("b")).alias("before"), mean(F.col("a")).alias("after"), mean(F.col("bu").cast("int")).alias("unk_before"), mean(F.col("au").cast("int")).alias("unk_after"))


def fvt_sources(pieces: DataFrame, base: DataFrame, spelled: Callable[[Column | str], Column]) -> DataFrame:
    """``piece, pos, source_id``: the base ids whose vectors make up each new piece's first vector."""
    parts = pieces.select("piece", F.posexplode(spelled("piece")).alias("pos", "source"))
    return parts.join(base.select(F.col("piece").alias("source"), F.col("id").alias("source_id")), "source").select("piece", "pos", "source_id")


def mean_vectors(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """The element-wise mean vector of each group, as an array in place order."""
    each = vectors.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
