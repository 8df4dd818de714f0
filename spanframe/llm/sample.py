"""Samples that stay as the data grows: nested hash buckets.

Every key belongs for ever to one of ``BUCKETS`` fine buckets. A seed gives a fixed permutation of the buckets; a sample of share f is the
first f·BUCKETS of them. What a row's fate depends on is its key, the seed and f alone: reruns, partitionings and later rows change nothing, and a larger
share with the same seed only appends buckets. The share is met as n independent draws meet it; no quota is filled up,
since that would have to drop rows chosen before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.operators.splits import normal_split

BITS = 20
BUCKETS = 1 << BITS
_MASK = BUCKETS - 1
#: Runs whose settings one pass over the sentences carries.
RUN_BLOCK = 20_000


def bucket(*keys: Column | str) -> Column:
    """The permanent bucket of a key: never change this, or every sample changes."""
    return F.xxhash64(F.lit("nested-buckets"), *(F.col(k) if isinstance(k, str) else k for k in keys)).bitwiseAND(_MASK)


def position(bucket_number: Column, seed: Column) -> Column:
    """The place of a bucket in the seed's permutation: three rounds of steps that each can be undone modulo 2^BITS."""
    x = bucket_number
    for round_number in range(3):
        key = F.xxhash64(seed.cast("long"), F.lit(round_number))
        odd = key.bitwiseAND(_MASK).bitwiseOR(F.lit(1).cast("long"))
        shift = F.shiftrightunsigned(key, BITS).bitwiseAND(_MASK)
        x = (x * odd + shift).bitwiseAND(_MASK)
        x = x.bitwiseXOR(F.shiftright(x, BITS // 2 - 1))
    return x


def bucket_count(fraction: float) -> int:
    """How many buckets of the list a share takes."""
    if fraction is None or math.isnan(fraction) or not 0 < fraction <= 1:
        raise ValueError(f"fraction must lie in (0, 1], not {fraction}")
    return math.ceil(fraction * BUCKETS)


def nested_sample(df: DataFrame, keys: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """The rows of ``df`` whose key is in the sample; all its columns, one narrow pass.

    Rows of one key are chosen together; a null key is a key like any other; an empty table gives an empty one. Fractions outside (0, 1] are an error.
    """
    return df.filter(position(bucket(*keys), F.lit(seed)) < bucket_count(fraction))


def run_settings(runs: DataFrame) -> DataFrame:
    """``run_id, fraction, seed, reason``, one row per run: the last registration counts.

    A missing fraction is 1.0, a missing seed 42. ``reason`` names what is wrong with a fraction outside (0, 1], else null.
    """
    fields = F.struct(
        F.coalesce("config.data.train_fraction", F.lit(1.0)).alias("fraction"),
        F.coalesce("config.data.subsample_seed", F.lit(42)).cast("long").alias("seed"),
    )
    last = runs.filter("run_id is not null").groupBy("run_id").agg(F.max_by(fields, F.struct("registered_at", fields)).alias("x"))
    wrong = F.when(F.isnan("x.fraction") | (F.col("x.fraction") <= 0) | (F.col("x.fraction") > 1), F.lit("fraction outside (0, 1]"))
    return last.select("run_id", "x.fraction", "x.seed", wrong.alias("reason"))


def train_sentences(sentences: DataFrame, partitions: int | None = None) -> DataFrame:
    """The distinct train sentences over all deliveries, in ``partitions`` parts if given: one shuffle by sentence serves both."""
    train = sentences.filter((normal_split("split") == "train") & F.col("sentence_id").isNotNull()).select("sentence_id")
    return (train.repartition(partitions, "sentence_id") if partitions else train).distinct()


def run_samples(sentences: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, sentence_id``: the train sentences of each run with a usable fraction.

    A sentence's place is found once per distinct seed, whatever number of runs share it; what is made of a sentence are the rows of the
    result and one place per seed. The sentences are spread over the session's partitions before this fan-out. Seeds with their runs go to the
    workers in blocks of at most about :data:`RUN_BLOCK` runs, so that what is broadcast doesn't grow with the registry.
    """
    usable = run_settings(runs).filter("reason is null").select("run_id", "seed", F.ceil(F.col("fraction") * BUCKETS).alias("taken"))
    spark = sentences.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = train_sentences(sentences, parts).select("sentence_id", bucket("sentence_id").alias("bucket"), F.lit(0).alias("_k"))
    blocks = max(1, math.ceil(usable.count() / RUN_BLOCK))
    out = None
    for block in range(blocks):
        part = usable if blocks == 1 else usable.filter(F.pmod(F.xxhash64("run_id"), F.lit(blocks)) == block)
        by_seed = part.groupBy("seed").agg(F.collect_list(F.struct("run_id", "taken")).alias("runs")).withColumn("_k", F.lit(0))
        placed = keyed.join(F.broadcast(by_seed), "_k").withColumn("place", position(F.col("bucket"), F.col("seed")))
        chosen = placed.select(F.explode(F.filter("runs", lambda r: F.col("place") < r["taken"])["run_id"]).alias("run_id"), "sentence_id")
        out = chosen if out is None else out.unionByName(chosen)
    return out
