"""Ordered rules as one CASE WHEN: the first rule that holds decides."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from carewise.functions.text import SPACES, WORD

# A word edge by letters, numbers and the underscore: combining marks, variation selectors and
# joiners, which stand around many emoji, are no word characters.
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def guarded(pattern: str) -> str:
    """A pattern of the form \\b(one|two)\\b with a look at the first letter in front.

    Most words of a text start no alternative. The guard rejects them by one character
    instead of trying every alternative, which nearly halves the time of a cascade. A pattern
    of another form, or one whose alternatives do not all start with a fixed character, stays.
    """
    if not (pattern.startswith(r"\b(") and pattern.endswith(r")\b")) or "[" in pattern:
        return pattern
    inner = pattern[3:-3]
    starts, depth, at = [0], 0, 0
    while at < len(inner):
        if inner[at] == "\\":
            at += 1
        elif inner[at] in "()":
            depth += 1 if inner[at] == "(" else -1
            if depth < 0:  # the outer brackets are not one group
                return pattern
        elif inner[at] == "|" and depth == 0:
            starts.append(at + 1)
        at += 1
    firsts = set()
    for start in starts:
        first, after = inner[start:start + 1], inner[start + 1:start + 2]
        if not first.isalnum() or after in ("?", "*", "{"):
            return pattern
        firsts.add(first)
    return rf"\b(?=[{''.join(sorted(firsts))}])({inner})\b"


def found(text: Column, pattern: str) -> Column:
    """True where ``pattern`` occurs in ``text``, which is lower-cased already.

    Edges, digits and white space are those of Unicode text; a pattern with capitals is one
    of a user's own rules and matches in either case.
    """
    flags = "(?d)" if pattern == pattern.lower() else "(?diu)"
    spelt = guarded(pattern).replace(r"\b", EDGE).replace(r"\d", r"\p{Nd}").replace(r"\s", f"[{SPACES}]")
    return text.rlike(flags + spelt)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True where one of the plain substrings occurs."""
    condition = F.lit(False)
    for word in words:
        condition = condition | text.contains(word)
    return condition


def first_match(rules: Iterable[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """Outcome of the first rule whose condition is true; conditions after it are not evaluated."""
    chain = None
    for condition, outcome in rules:
        chain = F.when(condition, outcome) if chain is None else chain.when(condition, outcome)
    if chain is None:
        raise ValueError("a cascade needs at least one rule")
    return chain if otherwise is None else chain.otherwise(otherwise)
