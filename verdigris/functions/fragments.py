"""Rules over one text in Python: patterns, fragments and amounts of court judgments.

A judgment's rules depend on one another through lists of parties, orders and
claims.  As column expressions they are interpreted value by value; here they
are plain functions that an Arrow function calls for each row.  What depends on a
fragment alone is remembered, up to a bound: phrases come again and again.
"""

from __future__ import annotations

import re
from functools import cache, lru_cache

from verdigris.functions import court_tables as c

#: Fragments remembered by a worker for each question that is asked of them.
KEPT = 1 << 13


@cache
def compiled(pattern: str) -> re.Pattern:
    """A pattern of the rule tables, as SQL reads it: classes are ASCII, and the end is the end of the text."""
    return re.compile(pattern.replace("\\z", "\\Z").replace("$", "\\Z"), re.ASCII)


def strip(text: str) -> str:
    return text.strip(c.BLANKS)


def has(text: str, pattern: str) -> bool:
    return compiled(pattern).search(text) is not None


def found(text: str | None, pattern: str, group: int = 1) -> str | None:
    """What a group of the first match has, None without one."""
    m = None if text is None else compiled(pattern).search(text)
    return (m.group(group) or None) if m else None


def first_name(text: str, table: list[tuple[str, str]], other: str) -> str:
    """The name of the first pattern that the text has."""
    return next((name for name, pattern in table if has(text, pattern)), other)


def number(text: str, pattern: str = c.AMOUNT) -> float | None:
    raw = found(text, pattern)
    return float(raw.replace(",", "")) if raw else None


def amount_count(text: str) -> int:
    return sum(1 for _ in compiled(c.AMOUNT).finditer(text))


def amount_near(text: str, words: tuple[str, ...]) -> float | None:
    """The first amount that stands shortly after one of the words, the earliest and longest word first."""
    for i, minus in sorted((i, -len(w)) for w in words if (i := text.find(w)) >= 0):
        if (got := number(text[i : i + c.NEAR - minus])) is not None:
            return got
    return None


def in_context(text: str, rule: c.ClaimRule) -> bool:
    """Whether the text has a word of the rule, with a word of its context near where it has one."""
    context = rule.context
    for w in rule.words:
        if w in text and (not context or _near(text, w, context)):
            return True
    return False


def _near(text: str, w: str, context: tuple[str, ...]) -> bool:
    at = text.find(w)
    while at >= 0:
        about = text[max(at - c.AROUND, 0) : at + len(w) + c.AROUND]
        if any(k in about for k in context):
            return True
        at = text.find(w, at + len(w))
    return False


def has_word(text: str, words: tuple[str, ...]) -> bool:
    for w in words:  # a loop, as this is asked most of all
        if w in text:
            return True
    return False


@lru_cache(64)
def fragments(text: str) -> tuple[str, ...]:
    """The sentences of a text; the few texts of a judgment are asked for by every claim."""
    return tuple(s for s in map(strip, compiled(c.SENTENCES).split(text)) if s)


@lru_cache(KEPT)
def _asks(fragment: str) -> tuple[str, bool, bool]:
    flat = strip(compiled("[\\s 　]+").sub(" ", fragment))
    return flat, has(flat, c.DEFENCE_MARK), has(flat, c.REQUEST_MARK)


def is_request(fragment: str, words: tuple[str, ...] = ()) -> bool:
    """Whether a fragment asks for something, rather than arguing about it."""
    flat, defends, asks = _asks(fragment)
    if defends:
        return False
    return asks or any(w in flat and has(flat[: flat.find(w)], c.REQUEST_BEFORE) for w in words)
