"""Registries of named things that a command or a configuration picks: metrics, entity subsets, tokenizers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Named:
    """Things of one kind by name. A name is given once; an unknown one is an error that lists the known."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self.known: dict[str, Any] = {}

    def register(self, name: str) -> Callable[[Any], Any]:
        def add(thing: Any) -> Any:
            if name in self.known:
                raise ValueError(f"{self.kind} {name!r} is registered twice")
            self.known[name] = thing
            return thing

        return add

    def __getitem__(self, name: str) -> Any:
        if name not in self.known:
            raise KeyError(f"no {self.kind} is named {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name]


#: (vocabulary, lower case) -> function from (DataFrame for its session) to a column function from words to arrays of pieces.
TOKENIZERS = Named("tokenizer")


@TOKENIZERS.register("wordpiece")
def _wordpiece(df, vocabulary, lowercase=False):
    from spanframe.functions import wordpiece as WP

    return WP.wordpiece(df, vocabulary, lowercase)


@TOKENIZERS.register("fixed_width")
def _fixed_width(df, vocabulary, lowercase=False):
    from pyspark.sql import functions as F

    from spanframe.functions import wordpiece as WP

    return lambda word: WP.fixed_width_pieces(F.lower(word) if lowercase else word)
