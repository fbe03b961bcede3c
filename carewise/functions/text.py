"""Text cleaning, normalisation and tokenising as Column expressions."""

from __future__ import annotations

import html
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from carewise.functions.rulebook import SNIPPET_LENGTH

# White space as the cleaner means it: ASCII controls, NEL and every Unicode separator.
SPACES = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
# Rows with an ampersand, or with a character outside these ranges, may change under
# unescaping or NFKC. The ranges hold only stable, non-composing characters.
MAY_CHANGE = (
    r"&|[^\x00-\x7F"
    r"\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{FF}"
    r"\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{20AC}\x{FFFD}\x{1F300}-\x{1FAFF}]"
)


def _unescape_and_compose():
    """The Arrow UDF; defined inside, so that executors need not have this package.

    Marked nondeterministic so that Catalyst evaluates it, and the cleaner above it, once:
    a filter on cleaned text would otherwise be pushed down as a copy of the whole cleaner.
    """

    def one(text: str) -> str:
        return unicodedata.normalize("NFKC", html.unescape(text).replace("\ufffd", "'"))

    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return F.pandas_udf(decode, StringType()).asNondeterministic()


def decode_text(text: Column) -> Column:
    """HTML unescape once, U+FFFD to an apostrophe, then NFKC.

    Spark has no built-in for the first and the last. Only rows that may change send
    their text to Python; the others send null and keep the native expression.
    """
    decoded = _unescape_and_compose()(F.when(text.rlike(MAY_CHANGE), text))
    return F.coalesce(decoded, F.translate(text, "�", "'"))


def strip_noise(text: Column) -> Column:
    """Remove URLs, then handles, then collapse white space and trim."""
    no_urls = F.regexp_replace(text, rf"https?://[^{SPACES}]+", "")
    no_handles = F.regexp_replace(no_urls, rf"@[A-Za-z0-9_]++(?![{WORD}])", "")
    return F.trim(F.regexp_replace(no_handles, rf"[{SPACES}]+", " "))


def clean_text(text: Column) -> Column:
    """The whole cleaner; null gives the empty string."""
    return strip_noise(decode_text(F.coalesce(text, F.lit(""))))


def strip_spaces(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"\A[{SPACES}]+|[{SPACES}]+\z", "")


def comparison_key(text: Column) -> Column:
    """Lower-cased, trimmed text for joins and de-duplication."""
    return F.lower(strip_spaces(text))


def snippet(text: Column, length: int = SNIPPET_LENGTH) -> Column:
    """The first characters, always followed by three dots."""
    return F.concat(F.substring(F.coalesce(text, F.lit("")), 1, length), F.lit("..."))


def end_sentence(text: Column) -> Column:
    """Add a full stop unless the text ends in terminal punctuation."""
    return F.concat(text, F.when(text.rlike(r"[.!?]\z"), "").otherwise("."))


def fixed(number: Column, places: int) -> Column:
    """The number with a fixed count of decimals, rounded by its exact value, ties to even."""
    return F.call_function("format_number", number, F.lit("0." + "0" * places))


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rf"\A[{SPACES}]*\z")


def seeded_order(key: Column, seed: int) -> Column:
    """A repeatable pseudo-random order of keys, the same on any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Characters that lose an accent and their base letters, then marks to delete."""
    accented, bases, marks = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        if not char.isalnum():
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char and unicodedata.normalize("NFKC", char) == char:
            accented.append(char)
            bases.append(base)
    return "".join(accented + marks), "".join(bases)


def fold_accents(text: Column) -> Column:
    """Letters without their accents, for text already in NFKC form."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, *_accent_table())).otherwise(text)


def tokens(text: Column, stop_words: Sequence[str] = (), strip_accents: bool = True) -> Column:
    """Lower-cased words of two or more characters without the stop words, in order."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(
        fold_accents(lowered) if strip_accents else lowered, F.lit(rf"[{WORD}]{{2,}}"), F.lit(0)
    )
    if not stop_words:
        return words
    return F.filter(words, lambda word: ~word.isin(list(stop_words)))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` words, joined by a blank."""
    def joined(n: int) -> Column:
        if n == 1:
            return words
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
        runs = F.transform(starts, lambda start: F.array_join(F.slice(words, start, F.lit(n)), " "))
        return F.coalesce(runs, F.array().cast("array<string>"))

    runs = [joined(n) for n in range(low, high + 1)]
    return runs[0] if len(runs) == 1 else F.concat(*runs)
