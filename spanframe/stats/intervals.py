"""Percentile intervals, bootstrap p-values, step-down correction and the exact sign-flip test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seeds up to which all sign patterns are tried.
MOST_SEEDS = 16
#: Differences up to which sign sums are counted by halves; the work doubles with every two more.
MOST_SPLIT = 50
TOLERANCE = 1e-12


def interval(value: Column | str, level: float = 0.95) -> tuple[Column, Column]:
    """The percentile interval of an aggregate, with linear interpolation; nulls and NaN are left out."""
    c = F.nanvl(F.col(value) if isinstance(value, str) else value, F.lit(None).cast("double"))
    tail = (1 - level) / 2
    return F.percentile(c, tail), F.percentile(c, 1 - tail)


def two_sided_p(delta: Column | str) -> Column:
    """The two-sided bootstrap p-value of an aggregate of replicates; never 0."""
    c = F.col(delta) if isinstance(delta, str) else delta
    n = F.count(c)
    return F.least(F.lit(1.0), 2 * F.least((1 + F.count_if(c <= 0)) / (1 + n), (1 + F.count_if(c >= 0)) / (1 + n)))


def holm(df: DataFrame, p: str, order: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``p_holm``: the step-down correction within each group of ``by``; ties by ``order``. One row per hypothesis."""
    keys = [F.col(c) for c in by] if by else [F.lit(0)]
    ranked = Window.partitionBy(*keys).orderBy(p, order)
    m = F.count("*").over(Window.partitionBy(*keys))
    scaled = df.withColumn("_s", F.least(F.lit(1.0), (m - F.row_number().over(ranked) + 1) * F.col(p)))
    return scaled.withColumn("p_holm", F.max("_s").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")


def sign_flip(differences: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """``*by, k, p``: the exact two-sided sign-flip test of each group's differences (at most 16): the share of sign patterns whose mean is as large."""
    collected = differences.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("double").alias("d")))), lambda x: x["d"]).alias("d"))
    k = F.size("d")
    checked = collected.withColumn("k", F.when(k > MOST_SEEDS, F.raise_error(F.lit(f"the exact test takes at most {MOST_SEEDS} differences"))).otherwise(k).cast("int"))
    patterns = F.sequence(F.lit(0), F.expr("int(shiftleft(1, k)) - 1"))
    sums = F.transform(patterns, lambda m: F.aggregate(F.transform("d", lambda d, i: d * (1 - 2 * F.call_function("getbit", m, i))), F.lit(0.0), lambda a, b: a + b))
    observed = F.abs(F.aggregate("d", F.lit(0.0), lambda a, b: a + b))
    scored = checked.withColumn("_o", observed).withColumn("_s", sums)
    return scored.select(*by, "k", (F.size(F.filter("_s", lambda s: F.abs(s) >= F.col("_o") - TOLERANCE)) / F.size("_s")).alias("p"))


def _sign_sums(d: np.ndarray) -> np.ndarray:
    """The sums of all sign patterns of ``d``, sorted."""
    sums = np.zeros(1)
    for x in d:
        sums = np.concatenate([sums - x, sums + x])
    sums.sort()
    return sums


def sign_flip_share(d: np.ndarray) -> float:
    """The share of all 2^k sign patterns whose sum is as large as that of ``d``, in absolute value, within the tolerance.

    Pattern sums of one half are sorted; those of the other, in blocks, are looked up in them: 2^(k/2) steps and no pattern left out.
    """
    if not 0 < len(d) <= MOST_SPLIT:
        raise ValueError(f"between 1 and {MOST_SPLIT} differences are needed")
    least = abs(float(np.sum(d))) - TOLERANCE
    if least <= 0:
        return 1.0
    half = len(d) // 2
    held, rest = _sign_sums(d[:half]), d[half:]
    block = _sign_sums(rest[:20])
    count = 0
    for shift in _sign_sums(rest[20:]):
        other = block + shift
        # twice the upper tail: with a pattern its opposite is as large
        count += 2 * int((len(held) - np.searchsorted(held, least - other, side="left")).sum())
    return count / 2.0 ** len(d)


def sign_flip_split(differences: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """``*by, k, p`` as :func:`sign_flip`, for groups of at most 50 differences: larger ones raise an error. Nulls are left out."""
    schema = T.StructType([*(differences.schema[c] for c in by), T.StructField("k", T.IntegerType()), T.StructField("p", T.DoubleType())])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values(order)["_d"].to_numpy(float)
        return pd.DataFrame([(*key, len(d), sign_flip_share(d))], columns=schema.fieldNames())

    return differences.select(*by, order, F.col(value).cast("double").alias("_d")).filter("_d is not null").groupBy(*by).applyInPandas(run, schema)
