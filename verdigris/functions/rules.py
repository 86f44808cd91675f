"""Rules over text as column expressions: labels with snippets, sections, key words, actions.

A rule table is a short list known to the program, so it becomes one expression:
nothing is joined, and each text is read where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.legal_tables import Rule


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null without one."""
    return F.nullif(F.regexp_extract(text, f"({pattern})" if not group else pattern, group or 1), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def around(text: Column, found: Column, before: int, after: int) -> Column:
    """The text about a part of it: so many characters before and after, on one line."""
    start = F.greatest(F.position(found, text), F.lit(1))
    low = F.greatest(start - before, F.lit(1))
    return F.trim(F.regexp_replace(F.substring(text, low, start + F.length(found) + after - low), "\n+", " "))


def labels(text: Column, rules: list[Rule], before: int, after: int, bonus: float = 0.0) -> Column:
    """An array of (name, words, snippet, confidence): each rule with the first match of its patterns; ``bonus`` counts if several patterns match."""

    def one(rule: Rule) -> Column:
        found = F.array_compact(F.array(*(first_match(text, p) for p in rule.patterns)))
        confidence = F.least(F.lit(1.0), F.lit(rule.weight) + F.when(F.size(found) > 1, bonus).otherwise(0.0))
        return let(found, lambda w: F.when(F.size(w) > 0, F.struct(F.lit(rule.name).alias("name"), F.array_distinct(w).alias("words"), around(text, F.get(w, F.lit(0)), before, after).alias("snippet"), F.round(confidence, 2).alias("confidence"))))

    return F.array_compact(F.array(*map(one, rules)))


def labels_first(texts: list[tuple[Column, str, float, str]], rules: list[Rule], least: int, before: int, after: int) -> Column:
    """An array of (name, snippet, confidence, source): each rule in the first text where it matches.

    A text comes with the field of the rule that holds its patterns, what its
    hits lose in confidence (0.65 stays at least) and its name; texts of
    ``least`` characters or fewer are passed over, but for the last.
    """

    def hit(rule: Rule, k: int) -> Column:
        text, field, loss, source = texts[k]
        found = F.coalesce(*(first_match(text, p) for p in getattr(rule, field)))
        weight = round(max(0.65, rule.weight - loss) if loss else rule.weight, 2)
        left = before - 5 if field == "context" else before
        shaped = let(found, lambda w: F.struct(F.lit(rule.name).alias("name"), around(text, w, left, after).alias("snippet"), F.lit(weight).alias("confidence"), F.lit(source).alias("source")))
        return F.when(found.isNotNull() & ((F.length(text) > least) if k < len(texts) - 1 else F.lit(True)), shaped)

    def one(rule: Rule) -> Column:
        return F.coalesce(*(hit(rule, k) for k in range(len(texts))))

    return F.array_compact(F.array(*map(one, rules)))


def section(text: Column, opens: str, ends: str, clip: int = 0) -> Column:
    """What lies between a heading and the next one, trimmed; null without the heading."""
    end = ends if ends.endswith("\\z") else f"{ends}|\\z"
    out = F.when(text.rlike(opens), F.btrim(F.regexp_extract(text, f"(?:{opens})([\\s\\S]*?)(?:{end})", 1), F.lit(" \n\r\t　")))
    return F.substring(out, 1, clip) if clip else out


def has_any(text: Column, words: str | Sequence[str]) -> Column:
    """Whether the text has one of the words; a few may be given in one text, apart by blanks."""
    out = None
    for w in words.split() if isinstance(words, str) else words:
        hit = F.contains(text, F.lit(w))
        out = hit if out is None else out | hit
    return out


def names_of(text: Column, table: list[tuple[str, str | Sequence[str]]], none: str | None = None) -> Column:
    """The names whose key words the text has, in order; ``none`` alone without any."""
    found = F.array_compact(F.array(*(F.when(has_any(text, words), F.lit(name)) for name, words in table)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(none))) if none else found


def first_name(text: Column, table: list[tuple[str, str]], other: Column) -> Column:
    """The name of the first pattern that the text has."""
    out = None
    for name, pattern in table:
        out = F.when(text.rlike(pattern), F.lit(name)) if out is None else out.when(text.rlike(pattern), F.lit(name))
    return out.otherwise(other)


def without(text: Column, patterns: list[str]) -> Column:
    """The text without what the patterns match, trimmed."""
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return F.btrim(text, F.lit(" \n\r\t"))


def taken_in_turn(text: Column, words: list[tuple[str, list[str]]]) -> Column:
    """An array of (name, count): how often each name's words are found after those of all names before it are taken out.

    One pass over the list carries the text that is left, so a long phrase isn't
    counted again under a shorter one that comes later.
    """
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, ws)).alias("words")) for n, ws in words))
    start = F.struct(text.alias("left"), F.array().cast("array<struct<name:string,count:int>>").alias("found"))

    def next_word(state: Column, w: Column) -> Column:
        return F.struct(F.replace(state["left"], w, F.lit(" ")).alias("left"), (state["count"] + ((F.length(state["left"]) - F.length(F.replace(state["left"], w, F.lit("")))) / F.length(w)).cast("int")).alias("count"))

    def next_name(state: Column, entry: Column) -> Column:
        done = F.aggregate(entry["words"], F.struct(state["left"].alias("left"), F.lit(0).alias("count")), next_word)
        return let(done, lambda x: F.struct(x["left"].alias("left"), F.when(x["count"] > 0, F.concat(state["found"], F.array(F.struct(entry["name"].alias("name"), x["count"].alias("count"))))).otherwise(state["found"]).alias("found")))

    return F.aggregate(table, start, next_name)
