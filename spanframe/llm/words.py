"""Match words in Python, for operators that need whole texts there. Equal to ``functions.text.match_words``."""

from __future__ import annotations

import re
import unicodedata

from spanframe.functions.text import INVISIBLE

_INVISIBLE = re.compile(f"[{INVISIBLE}]")
#: Python's ``\w`` is exactly the Unicode letters and numbers and ``_``.
_WORDS = re.compile(r"\w+").findall


def normal(text: str) -> str:
    if _INVISIBLE.search(text):
        text = _INVISIBLE.sub("", text)
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.lower()


def match_words(text: str) -> list[str]:
    return _WORDS(normal(text))
