"""Distributed bootstraps over sentences: no counts reach the driver, and any engine draws the same.

A sentence's weight in a replicate is a Poisson(1) number that depends on its id, the replicate and the seed only, through whole-number
arithmetic. Replicate 0 is the data itself (every weight 1). Sums are made per sentence first and again before each shuffle, so what moves is
groups times replicates, whatever the number of sentences. The seeded forms of :mod:`spanframe.stats.bootstrap` draw as NumPy does, on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.tags import ratio
from spanframe.stats import intervals

#: A prime below 2^31: products of two residues stay below 2^62.
PRIME = (1 << 31) - 1
#: Differences of replicates are rounded to so many places before they are compared with 0: sums of doubles depend on their order.
PLACES = 12
COUNTS = ("n_correct", "n_pred", "n_gold")


def with_uniform(df: DataFrame, key: str, replicate: str, seed: int, out: str) -> DataFrame:
    """``df`` with ``out``: a number in (0, 1) with 31 random bits for each key, replicate and seed.

    Each round is a column of its own: put into one expression, the rounds would be written out many times over.
    """
    own = F.pmod(F.col(key).cast("long"), F.lit(PRIME))
    rep = F.col(replicate).cast("long")
    first = df.withColumn("_own", own).withColumn("_x", F.pmod(F.col("_own") * 48_271 + rep * 69_621 + F.lit(seed % 1_000_000).cast("long") * 16_807, F.lit(PRIME)))
    second = first.withColumn("_x", F.pmod(F.col("_x") * F.col("_x") + F.col("_x") * 12_345 + rep, F.lit(PRIME)))
    third = second.withColumn("_x", F.pmod(F.col("_x") * F.col("_x") + F.col("_x") * 6_789 + F.col("_own"), F.lit(PRIME)))
    return third.withColumn(out, (F.col("_x") + 0.5) / float(PRIME)).drop("_own", "_x")


def poisson_steps() -> list[float]:
    """The distribution function of Poisson(1) up to where 31 bits end: weights above 13 can't be drawn from so many bits."""
    steps, total = [], 0.0
    for k in range(13):
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    return steps


def replicated(sums: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """``sums`` once per replicate 0 to ``replicates`` with the weight ``w`` of its key in ``rep``; in replicate 0 it is 1."""
    each = sums.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    drawn = with_uniform(each, key, "rep", seed, "_u")
    weight = sum(((F.col("_u") > step).cast("int") for step in poisson_steps()), F.lit(0))
    return drawn.withColumn("w", F.when(F.col("rep") == 0, F.lit(1)).otherwise(weight)).drop("_u")


def _f1() -> Column:
    return ratio(2 * F.col("n_correct"), F.col("n_pred") + F.col("n_gold"))


def _f1_by_replicate(counts: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """``*by, rep, f1`` from sentence counts: summed by ``by`` and sentence before they are replicated."""
    sums = counts.groupBy(*by, "sentence_id").agg(*(F.sum(c).alias(c) for c in COUNTS))
    drawn = replicated(sums, "sentence_id", replicates, seed).groupBy(*by, "rep").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in COUNTS))
    return drawn.select(*by, "rep", _f1().alias("f1"))


def _summary(values: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``*by, name, low, high, p``: the value of replicate 0, and interval and two-sided p of the others."""
    v = F.round(value, PLACES)
    others = F.when(F.col("rep") > 0, v)
    low, high = intervals.interval(others)
    return values.groupBy(*by).agg(F.max(F.when(F.col("rep") == 0, F.col(value))).alias(name), low.alias("low"), high.alias("high"), intervals.two_sided_p(others).alias("p"))


def micro_f1(counts: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """``*by, f1, low, high``: F1 over all rows of a group with its 95 % interval, sentences resampled."""
    return _summary(_f1_by_replicate(counts, by, replicates, seed), by, "f1", "f1").drop("p")


def mean_f1(counts: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """``*by, f1, low, high``: the mean F1 of a group's runs (``run_id``) with its 95 % interval, sentences resampled together for all runs."""
    means = _f1_by_replicate(counts, [*by, "run_id"], replicates, seed).groupBy(*by, "rep").agg(F.avg("f1").alias("f1"))
    return _summary(means, by, "f1", "f1").drop("p")


def paired_f1(counts: DataFrame, a: str, b: str, replicates: int, seed: int) -> DataFrame:
    """``seeds, f1_a, f1_b, delta, low, high, p``: difference of the mean F1 of two arms over the seeds both have, sentences and seeds resampled.

    ``counts``: ``arm, seed, sentence_id`` and the three counts; rows of one arm and seed are summed. Both arms see the same drawn sentences
    and seeds. Without a common seed there is no row.
    """
    f1 = _f1_by_replicate(counts.filter(F.col("arm").isin(a, b)), ["arm", "seed"], replicates, seed)
    wide = f1.groupBy("seed", "rep").agg(*(F.max(F.when(F.col("arm") == arm, F.col("f1"))).alias(n) for n, arm in (("f1_a", a), ("f1_b", b))))
    both = wide.filter("f1_a is not null and f1_b is not null")
    # common seeds numbered from 0; they are few
    named = both.filter("rep = 0").select("seed", (F.row_number().over(Window.orderBy("seed")) - 1).alias("place"), F.count("*").over(Window.partitionBy()).alias("seeds"))
    gains = both.join(F.broadcast(named), "seed").select("rep", "place", "seeds", "f1_a", "f1_b", (F.col("f1_b") - F.col("f1_a")).alias("gain"))
    # each replicate draws as many places as there are seeds; replicate 0 has each once
    draws = gains.select("rep", "seeds").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.col("seeds").cast("int") - 1)))
    draws = with_uniform(draws.withColumn("_j", F.col("j") + 1), "_j", "rep", seed + 1, "_u")
    picked = F.floor(F.col("_u") * F.col("seeds")).cast("int")
    draws = draws.select("rep", F.when(F.col("rep") == 0, F.col("j")).otherwise(picked).alias("place"))
    means = draws.join(gains, ["rep", "place"]).groupBy("rep").agg(F.avg("gain").alias("gain"))
    observed = gains.filter("rep = 0").agg(F.count("*").alias("seeds"), F.avg("f1_a").alias("f1_a"), F.avg("f1_b").alias("f1_b")).filter("seeds > 0").withColumn("_k", F.lit(0))
    spread = _summary(means.withColumn("_k", F.lit(0)), ["_k"], "gain", "delta")
    return observed.join(spread, "_k").select("seeds", "f1_a", "f1_b", "delta", "low", "high", "p")


DID = "did"


def paired_recall(hits: DataFrame, arms: DataFrame, replicates: int, seed: int, primary: str = "primary", control: str = "specificity") -> DataFrame:
    """``pair, subset, delta, low, high, p, p_holm, h1, h2``: differences of the mean recall of two arms by subset, and the difference in differences.

    ``hits``: ``run_id, sentence_id, hit, subsets`` (an array); ``arms``: ``pair, run_id, arm`` with arm ``a`` or ``b``, delta is b less a. All pairs and
    subsets see the same drawn sentences. The row of subset ``did`` is ``primary`` less ``control``. ``p_holm`` corrects the primary p over the pairs;
    ``h1``: primary delta above 0 and corrected p below 0.05; ``h2``: difference in differences above 0 with its interval.
    """
    each = hits.select("run_id", "sentence_id", F.explode("subsets").alias("subset"), F.col("hit").cast("long").alias("hit"))
    sums = each.groupBy("run_id", "subset", "sentence_id").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    by_run = replicated(sums, "sentence_id", replicates, seed).groupBy("run_id", "subset", "rep").agg((F.sum(F.col("h") * F.col("w")) / F.nullif(F.sum(F.col("n") * F.col("w")), F.lit(0))).alias("recall"))
    sides = by_run.join(arms, "run_id").groupBy("pair", "subset", "rep").agg(*(F.avg(F.when(F.col("arm") == arm, F.col("recall"))).alias(arm) for arm in "ab"))
    deltas = sides.select("pair", "subset", "rep", (F.col("b") - F.col("a")).alias("delta")).filter("delta is not null")
    one = deltas.groupBy("pair", "rep").agg(*(F.max(F.when(F.col("subset") == s, F.col("delta"))).alias(n) for n, s in (("_p", primary), ("_c", control))))
    did = one.select("pair", F.lit(DID).alias("subset"), "rep", (F.col("_p") - F.col("_c")).alias("delta")).filter("delta is not null")
    found = _summary(deltas.unionByName(did), ["pair", "subset"], "delta", "delta")
    corrected = intervals.holm(found.filter(F.col("subset") == primary).select("pair", "p", "delta"), "p", "pair")
    first = corrected.select("pair", "p_holm", ((F.col("delta") > 0) & (F.col("p_holm") < 0.05)).alias("h1"))
    second = found.filter(F.col("subset") == DID).select("pair", ((F.col("delta") > 0) & (F.col("low") > 0)).alias("h2"))
    return found.join(first, "pair", "left").join(second, "pair", "left")
