"""Whole reports as named tables: fragmentation of words against errors, and transfer of one label set to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions import tags
from spanframe.operators import registry as R
from spanframe.operators import spans as S
from spanframe.operators import tables as Tb
from spanframe.session import stored
from spanframe.stats import logistic, resample


def fragmentation(errors: DataFrame, hits: DataFrame, group: str, replicates: int = 200, seed: int = 0, least: int = Tb.LEAST_CELL) -> dict[str, DataFrame]:
    """The tables of the fragmentation report, each by ``group``.

    ``errors``: entity words with ``group, run_id, sentence_id, piece_bin, freq_bin, pieces, freq, chars, is_begin, etype, error``; ``hits``: entities with
    ``group, run_id, seen, fertility_bin, hit``. Word errors by pieces, over all and within strata of frequency; recall by seen and fertility; odds
    ratios of an error by run; the geometric mean of the pieces' ratio with its bootstrap interval, null where a run has no errors or no right words.
    """
    errors, hits = stored(errors), stored(hits.withColumn("hit", F.col("hit").cast("int")))
    ratios = stored(logistic.odds_ratios_by(errors, "run_id").join(errors.select("run_id", group).distinct(), "run_id"))
    pieces = ratios.filter("feature = 'pieces'").groupBy(group).agg(F.exp(F.avg(F.log("odds_ratio"))).alias("m"), F.count_if(F.col("odds_ratio").isNull()).alias("without"))
    means = pieces.select(group, F.when(F.col("without") == 0, F.col("m")).alias("odds_ratio")).collect()
    intervals = [(r[group], r["odds_ratio"], *(logistic.bootstrap_odds_ratio(errors.filter(F.col(group).eqNullSafe(F.lit(r[group]))), replicates, seed) if r["odds_ratio"] is not None else (None, None))) for r in means]
    return {
        "word_error_by_pieces": Tb.run_strata(errors, "run_id", ["piece_bin"], "error", [group]),
        "word_error_by_pieces_within_frequency": Tb.run_strata(errors, "run_id", ["freq_bin", "piece_bin"], "error", [group], least),
        "entity_recall_by_fertility": Tb.run_strata(hits, "run_id", ["seen", "fertility_bin"], "hit", [group], least),
        "odds_ratios": ratios.select(group, "run_id", "feature", "odds_ratio"),
        "pieces_odds_ratio": errors.sparkSession.createDataFrame(intervals, f"`{group}` string, odds_ratio double, low double, high double"),
    }


def mapped(words: DataFrame, mapping: dict[str, str], sides: tuple[str, ...] = ("gold", "pred")) -> DataFrame:
    return words.withColumns({c: tags.map_tag(c, mapping) for c in sides})


def transfer(source: DataFrame, extra: DataFrame, mapping: dict[str, str], group: str, pieces: DataFrame, replicates: int = 1_000, seed: int = 0) -> dict[str, DataFrame]:
    """The tables of the transfer report, each by ``group``.

    ``source``: predictions on the source test set; ``extra``: on another set whose gold labels are target types already; both with ``group``. Steps:
    ``source`` as it is, ``source_mapped`` with both sides mapped, ``extra`` with mapped predictions. ``subsets``: scores on kinds of sentences of the extra
    set with the interval of the mean F1; ``recall_by_pieces``: recall of its entities by mean pieces, all sentences and ``other`` ones, every bin.
    ``pieces``: ``word, n_pieces, any_unk``.
    """
    extra = stored(mapped(extra, mapping, ("pred",)))
    steps = {"source": source, "source_mapped": mapped(source, mapping), "extra": extra}
    metrics = ("precision", "recall", "f1")
    scored = None
    for step, w in steps.items():
        part = S.prf(w, [group, "run_id"]).select(F.lit(step).alias("step"), group, "run_id", "etype", "support", *metrics)
        scored = part if scored is None else scored.unionByName(part)
    # every run has the same words: one run's sentences are the set's
    one = stored(extra.filter(F.col("run_id") == extra.agg(F.min("run_id")).first()[0]).select("sentence_id", "word_idx", "word", "gold"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"])
    subsets = stored(R.sentence_subsets(one.groupBy("sentence_id").agg(ordered.alias("words"))))
    counts = stored(S.sentence_counts(extra).join(extra.select("run_id", group).distinct(), "run_id"))
    own = R.subset_scores(counts, subsets).join(counts.select("run_id", group).distinct(), "run_id")
    interval = resample.mean_f1(counts.join(subsets, "sentence_id"), [group, "subset"], replicates, seed).select(group, "subset", "low", "high")
    entities = Tb.entity_table(one, pieces, one.select(F.col("word").alias("text"), F.lit("").alias("etype")).limit(0))
    found = S.side_spans(extra, S.SENTENCE, {"pred": "pred"}).select("run_id", "sentence_id", "etype", "start", "end").withColumn("hit", F.lit(1))
    each = entities.join(extra.select("run_id", group, "sentence_id").distinct(), "sentence_id").join(found, ["run_id", "sentence_id", "etype", "start", "end"], "left")
    kinds = each.withColumn("hit", F.coalesce("hit", F.lit(0))).join(subsets.filter("subset in ('all', 'other')"), "sentence_id")
    strata = Tb.run_strata(kinds, "run_id", ["subset", "fertility_bin"], "hit", [group])
    bins = kinds.select(group, "subset").distinct().withColumn("fertility_bin", F.explode(F.array(*(F.lit(b) for b in tags.FERTILITY_BINS))))
    return {
        "steps": R.transfer_summary(scored, ["step", group], metrics),
        "subsets": R.subset_summary(own, [group]).join(interval, [group, "subset"]),
        "recall_by_pieces": bins.join(strata, [group, "subset", "fertility_bin"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumnRenamed("mean", "recall").drop("runs"),
    }
