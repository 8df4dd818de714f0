"""Split names of any spelling, and sentences over repeated deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.text import col


def normal_split(split: Column | str) -> Column:
    """``train``, ``validation`` or ``test`` of any case, with stray blanks, ``valid`` and ``dev``; other values give null."""
    name = F.lower(F.trim(F.regexp_replace(col(split), r"(?U)\s+", " ")))
    return F.when(name.isin("train", "test", "validation"), name).when(name.isin("valid", "dev"), F.lit("validation"))


def sentence_splits(sentences: DataFrame) -> DataFrame:
    """``sentence_id, split, source``, one row per sentence: deliveries repeat rows, the least known value counts."""
    return sentences.groupBy("sentence_id").agg(F.min(normal_split("split")).alias("split"), F.min("source").alias("source"))
