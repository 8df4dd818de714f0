"""Text functions on the JVM: normal forms, line splitting, script shares, match words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's ``str.isspace`` characters, listed: Java's Unicode ``\s`` lacks U+001C to U+001F and is several times slower.
SPACE_CLASS = r"[ \t-\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The letters of the Cyrillic block U+0400 to U+04FF (fixed values).
CYRILLIC = r"\x{400}-\x{481}\x{48A}-\x{4FF}"
#: Line separators of Python's ``str.splitlines``.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Invisible characters that match words ignore (fixed values).
INVISIBLE = "­​‌‍⁠﻿"
WORD_PATTERN = r"[\p{L}\p{N}_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfc(c: Column | str) -> Column:
    """Unicode NFC through the ICU library that Spark ships: no Python worker, null stays null."""
    c = col(c)
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    # ASCII is always in NFC; the call is made for the rest only
    return F.when(c.rlike(r"[^\x00-\x7F]"), composed).otherwise(c)


def without_invisible(c: Column | str) -> Column:
    """The text without :data:`INVISIBLE` characters. Searching for each is several times cheaper than mapping every character, so texts that have none aren't mapped."""
    c = col(c)
    found = F.lit(False)
    for x in INVISIBLE:
        found = found | F.contains(c, F.lit(x))
    return F.when(found, F.translate(c, INVISIBLE, "")).otherwise(c)


def match_words(c: Column | str) -> Column:
    """The match words of a text: invisible characters removed, NFC, lower case, runs of letters, digits and ``_``."""
    return F.regexp_extract_all(F.lower(nfc(without_invisible(c))), F.lit(WORD_PATTERN), F.lit(0))


def squeeze(c: Column | str) -> Column:
    """Runs of white space to one space, none at either end. Texts with single plain spaces only aren't rewritten."""
    c = col(c)
    odd = SPACE_CLASS.replace("[ ", "[")
    return F.trim(F.when(c.rlike(f"{odd}|  "), F.regexp_replace(c, f"{SPACE_CLASS}+", " ")).otherwise(c))


def normalize_line(c: Column | str) -> Column:
    """NFC, runs of white space to one space, no space at either end."""
    return squeeze(nfc(c))


def split_lines(c: Column | str) -> Column:
    """The lines of a text as ``str.splitlines`` gives them: no empty element after a final separator."""
    c = col(c)
    lines = F.split(c, LINE_BREAK)
    last = F.element_at(lines, -1)
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.when(last == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines))


def count_in(c: Column, letters: str) -> Column:
    """How many characters of ``c`` the class body ``letters`` has: runs are cut out, no array of matches is built."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{letters}]+", ""))


def script_share(c: Column | str, letters: str) -> Column:
    """Share of the letters of ``c`` that the character class body ``letters`` has (letters only); null where there are none."""
    c = col(c)
    return count_in(c, letters) / F.nullif(count_in(c, r"\p{L}"), F.lit(0))


def is_kazakh(c: Column | str) -> Column:
    """At least half of the letters Cyrillic and one of the letters only Kazakh has; texts without letters: false."""
    share = script_share(c, CYRILLIC)
    return F.coalesce((share >= 0.5) & col(c).rlike("[әғқңөұүһіӘҒҚҢӨҰҮҺІ]"), F.lit(False))


def folded_words(c: Column | str) -> Column:
    """Words of the case-folded NFC text; of the full case folding only ``ß`` differs from lower case in these scripts.

    Java's ``\\w`` would count combining marks and other connectors as well: letters, numbers and ``_`` are meant.
    """
    return F.regexp_extract_all(F.replace(F.lower(nfc(c)), F.lit("ß"), F.lit("ss")), F.lit(WORD_PATTERN), F.lit(0))


def word_count(c: Column | str) -> Column:
    """Words of a normalised line: parts between single spaces."""
    return F.size(F.split(col(c), " "))
