"""Greedy longest-match WordPiece, and piece tables over distinct words.

A tokenizer is costly, words repeat: pieces are found once per distinct word by an Arrow function and joined back.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNK = "[UNK]"
MAX_CHARS = 100


def spell(piece: str, vocabulary: set[str] | dict[str, int], max_chars: int = MAX_CHARS) -> list[str] | None:
    """The vocabulary's pieces that spell ``piece`` (which may itself be a ``##`` continuation); None where they can't.

    The longest match from the left is taken each time; a piece of more than ``max_chars`` characters isn't spelt.
    """
    inner = piece.startswith("##")
    return _longest_matches(piece[2:] if inner else piece, "##" if inner else "", vocabulary, max_chars)


def _longest_matches(rest: str, mark: str, vocabulary: set[str] | dict[str, int], max_chars: int = MAX_CHARS) -> list[str] | None:
    if not 0 < len(rest) <= max_chars:
        return None
    out: list[str] = []
    while rest:
        end = next((e for e in range(len(rest), 0, -1) if mark + rest[:e] in vocabulary), 0)
        if not end:
            return None
        out.append(mark + rest[:end])
        rest, mark = rest[end:], "##"
    return out


def tokenize_word(word: str | None, vocabulary: set[str] | dict[str, int], lowercase: bool = False) -> list[str]:
    """The pieces of one word; a word that can't be spelt, and the empty one, is one unknown piece. ``##`` at a word's start is its own text."""
    text = (word or "").lower() if lowercase else (word or "")
    return _longest_matches(text, "", vocabulary) or [UNK]


def pieces_udf(tokenize: Callable[[str], list[str]]) -> Callable[[Column | str], Column]:
    """An Arrow function from words to arrays of pieces."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(words: pd.Series) -> pd.Series:
        return words.map(lambda w: tokenize(w) if w is not None else None)

    return pieces


def wordpiece(df: DataFrame, vocabulary: list[str], lowercase: bool = False) -> Callable[[Column | str], Column]:
    """The Arrow function of a WordPiece vocabulary, broadcast once (vocabularies are bounded: some 100,000 pieces)."""
    shared = df.sparkSession.sparkContext.broadcast(dict.fromkeys(vocabulary))
    return pieces_udf(lambda w: tokenize_word(w, shared.value, lowercase))


def piece_table(words: DataFrame, tokenize: Callable[[Column | str], Column], column: str = "word") -> DataFrame:
    """``word, pieces, n_pieces, is_unk, any_unk`` of the distinct words: ``is_unk`` if unknown as a whole, ``any_unk`` if any piece is."""
    found = words.select(column).distinct().select(F.col(column).alias("word"), tokenize(column).alias("pieces"))
    return found.select("word", "pieces", F.size("pieces").alias("n_pieces"), (F.col("pieces") == F.array(F.lit(UNK))).alias("is_unk"), F.array_contains("pieces", UNK).alias("any_unk"))


def fixed_width_pieces(word: Column | str, width: int = 4) -> Column:
    """Pieces of ``width`` characters, JVM-side: a stand-in for a tokenizer that any engine can compute."""
    c = F.col(word) if isinstance(word, str) else word
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(c) / width) - 1, F.lit(0)).cast("int"))
    return F.transform(starts, lambda i: F.concat(F.when(i > 0, "##").otherwise(""), F.substring(c, i * width + 1, F.lit(width))))
