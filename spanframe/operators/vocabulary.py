"""Vocabularies as tables: ids without gaps, extension by candidates, pieces in context, agreement of two ways of tokenizing.

Pieces are never learned here: a learner's list of pieces is an input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.functions import wordpiece as WP
from spanframe.operators import fertility as Fe

#: Pieces of a vocabulary that the driver takes at most.
MOST_PIECES = 2_000_000
MARKS = ("[CLS]", "[SEP]", WP.UNK)


def collected(pieces: DataFrame, most: int = MOST_PIECES) -> list[str]:
    """The distinct pieces of a ``piece`` column in code point order; refused beyond ``most``: vocabularies are bounded, corpora aren't."""
    found = [r[0] for r in pieces.select("piece").filter("piece is not null").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} pieces are no vocabulary")
    return sorted(found)


def numbered(spark: SparkSession, pieces: list[str]) -> DataFrame:
    """``piece, id``: ids from 0 in the list's order."""
    return spark.createDataFrame([(p, i) for i, p in enumerate(pieces)], "piece string, id int")


def with_marks(pieces: list[str]) -> list[str]:
    """The pieces with the marks that a model's input needs, where they lack them, at the end."""
    return pieces + [m for m in MARKS if m not in set(pieces)]


def require_contiguous(vocabulary: DataFrame) -> None:
    """An error unless the ids of ``piece, id`` run from 0 without gaps or repeats and no piece is null or repeated."""
    r = vocabulary.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count_distinct("piece").alias("pieces")).first()
    if r["n"] and (r["ids"], r["lo"], r["hi"], r["pieces"]) != (r["n"], 0, r["n"] - 1, r["n"]):
        raise ValueError(f"{r['n']} entries have {r['pieces']} pieces and {r['ids']} ids from {r['lo']} to {r['hi']}: ids must run from 0 without gaps, pieces be distinct")


@dataclass(frozen=True)
class Extension:
    """What an extension is made of: all ``candidates`` (``piece, n, skip``), the pieces ``added`` (``piece, n``), the wider ``vocabulary`` (``piece, id``)."""

    candidates: DataFrame
    added: DataFrame
    vocabulary: DataFrame

    def skipped(self) -> DataFrame:
        """``skip, pieces``: how many pieces each reason kept out."""
        return self.candidates.filter("skip is not null").groupBy("skip").agg(F.count("*").alias("pieces"))


def append(base: DataFrame, pieces: list[str]) -> DataFrame:
    """``piece, id``: old ids stay, ``pieces`` follow in their order. Pieces that are there already, or repeated, are an error."""
    require_contiguous(base)
    spark = base.sparkSession
    new = spark.createDataFrame([(p, i) for i, p in enumerate(pieces)], "piece string, place int")
    known = [r[0] for r in base.join(new, "piece", "left_semi").select("piece").orderBy("piece").limit(5).collect()]
    if known or len(set(pieces)) != len(pieces):
        raise ValueError(f"pieces must be new and distinct{': ' + ', '.join(known) if known else ''}")
    size = base.count()
    return base.select("piece", F.col("id").cast("int").alias("id")).unionByName(new.select("piece", (F.col("place") + size).cast("int").alias("id")))


def extend(base: DataFrame, learned: DataFrame, usage: DataFrame, most: int) -> Extension:
    """The ``most`` used candidates among ``learned`` (``piece``) appended to ``base`` (``piece, id``); ``usage`` is ``piece, n``.

    Pieces the base has, of one character, that it can't spell, or that aren't used are no candidates. The appended pieces are ``most`` rows.
    """
    known = base.sparkSession.sparkContext.broadcast(set(collected(base)))

    @F.pandas_udf("boolean")
    def spellable(pieces):
        return pieces.map(lambda p: WP.spell(p, known.value) is not None)

    found = Fe.candidates(learned, base, usage, spellable)
    listed = [(r["piece"], r["n"]) for r in Fe.top_candidates(found, most).collect()]
    added = base.sparkSession.createDataFrame(listed, "piece string, n long")
    return Extension(found, added, append(base, [p for p, _ in listed]))


def pieces_in_context(sentences: DataFrame, vocabulary: list[str], key: str, tokens: str) -> DataFrame:
    """``key, word_idx, word, pieces, unk`` of the words of pre-split sentences, tokenized a sentence at a time.

    ``vocabulary`` lists the pieces by id and holds the marks (:func:`with_marks`). Null and empty sentences give no rows.
    """
    from spanframe.operators.align import tokenized_words

    unknown = vocabulary.index(WP.UNK)
    encoded = tokenized_words(sentences.select(key, tokens), vocabulary, tokens)
    each = encoded.select(key, tokens, F.explode(F.arrays_zip("input_ids", "word_ids")).alias("x")).filter("x.word_ids is not null")
    word = F.get(tokens, F.col("x.word_ids"))
    return each.groupBy(key, F.col("x.word_ids").alias("word_idx")).agg(F.first(word).alias("word"), F.count("*").cast("int").alias("pieces"), F.max(F.col("x.input_ids") == unknown).alias("unk"))


Encoder = Callable[[str], tuple[list[int], list[tuple[int, int]]]]


def pieces_by_word(words: list[str], ids: list[int], offsets: list[tuple[int, int]]) -> list[list[int]]:
    """The pieces of a running text, its words joined by one space, given to words by their last character.

    A piece that ends in the space between two words belongs to the next one; what lies behind the last word belongs to it.
    """
    if not words:
        return []
    # where each word ends, and the last character of each piece; a piece without characters stands at its start
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    bounds = np.asarray(offsets, np.int64).reshape(-1, 2)
    owners = np.searchsorted(ends, bounds.max(axis=1) - (bounds[:, 0] < bounds[:, 1]), side="right").clip(max=len(words) - 1)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return [part.tolist() for part in np.split(np.asarray(ids, np.int64)[order], np.cumsum(counts)[:-1])]


def split_mismatches(sentences: DataFrame, key: str, tokens: str, split: Callable[[str], list[int]], running: Encoder) -> DataFrame:
    """``key, word_idx, word``: words whose pieces differ between pre-split input and the same sentence as running text.

    ``split`` gives the piece ids of one word by itself, ``running`` the ids and character offsets of a text. Byte-level tokenizers, for one, mark
    the space before a word, which a word by itself lacks. Sentences are compared where they lie, in Arrow batches; null and empty ones give no rows.
    """
    schema = T.StructType([sentences.schema[key], T.StructField("word_idx", T.IntegerType()), T.StructField("word", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, index, found = [], [], []
            for row, words in enumerate(batch.column(1).to_pylist()):
                if words:
                    for i, own in enumerate(pieces_by_word(words, *running(" ".join(words)))):
                        if own != split(words[i]):
                            at.append(row)
                            index.append(i)
                            found.append(words[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(found, pa.string())], [key, "word_idx", "word"])

    return sentences.select(key, tokens).mapInArrow(run, schema)
