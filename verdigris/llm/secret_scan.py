"""Secret scan: fixed patterns, and a battery of randomness tests.

Candidates are long runs of key characters, and the runs of letters and digits
within them.  Each candidate's encoding is inferred (hexadecimal, base 32, base
36, base 64), and tests ask whether it could be uniformly random in that
alphabet: chi-squared of the symbol counts and of the counts by class of symbol
(capitals, small letters, digits, marks), runs above and below the middle of the
alphabet and of symbols of one class, and lag-1 serial correlation.  Fisher's method combines them; a
candidate without encoding has no p-value and is no secret.

A random candidate's p-value is uniform, so those above one half tell how many
random candidates the corpus has, and how many of them any threshold claims; what
it claims beyond that are ordinary candidates, the false discoveries.  The
threshold is the lowest at which their share of all claims stays within
``alpha``.  It falls with a candidate's length, as ordinary text of twice the
length has a far smaller p-value.  Only counts by length and p-value decide.

The tests depend on the candidate alone, so texts are read once and never
shuffled or joined.  Native: DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import materialise

# Fixed values of the contract: kinds in their order, patterns, least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ["assign", "access", "hex", "random"]

#: Candidates of the method, runs within them, and the share of claimed secrets that may be ordinary text.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
INNER = r"[A-Za-z0-9]{20,}"
ALPHA = 0.05
#: The p-value from which on a candidate counts as random when their number is estimated.
HALF = 0.5
#: p-values are counted on a grid of so many steps for each power of ten, down to this power; below it nothing is claimed.
STEPS, POWERS = 16, 2
#: p-values are weighted by length over the first number; lengths count up to the second.
BASE_LENGTH, FULL_LENGTH = 20, 128
ALPHABETS = {
    "hex": "0123456789abcdef",
    "b32": "abcdefghijklmnopqrstuvwxyz234567",
    "b36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/"]
_CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(numbers: Column, zero: float = 0) -> Column:
    return F.aggregate(numbers, F.lit(zero), lambda a, x: a + x)


def _before(sizes: Column) -> Column:
    """The sum of the sizes before each place; sums of chunks come first, so that the work stays near linear in a long array."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _CHUNK).cast("int")), lambda c: _sum(F.slice(sizes, c * _CHUNK + 1, F.lit(_CHUNK))))
    starts = F.aggregate(chunks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return let(starts, lambda s: F.transform(sizes, lambda _, i: F.get(s, F.floor(i / _CHUNK).cast("int")) + _sum(F.slice(sizes, i - i % _CHUNK + 1, i % _CHUNK))))


def find(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Spans (start, kind, end, value) of the leftmost matches that don't overlap, whose group has at least so many characters."""
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else every

    def spans(x: Column) -> Column:
        gap, size, values = x["gap"], x["size"], x["value"]
        both = F.zip_with(F.slice(gap, F.lit(1), F.size(size)), size, lambda a, b: a + b)
        out = let(both, lambda b: let(_before(b), lambda at: F.transform(size, lambda n, i: F.struct((F.get(at, i) + F.get(gap, i)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (F.get(at, i) + F.get(gap, i) + n).alias("end"), F.get(values, i).alias("value")))))
        return F.filter(out, lambda s: F.length(s["value"]) >= least)

    parts = F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(every, F.length).alias("size"), value.alias("value"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(none)


def blank(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """The text with spaces in place of what find() would find."""
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else every
    sized = F.arrays_zip(every.alias("m"), value.alias("v"))
    filled = F.transform(sized, lambda x: F.when(F.length(x["v"]) >= least, F.repeat(F.lit(" "), F.length(x["m"]))).otherwise(x["m"]))
    joined = F.array_join(F.zip_with(F.split(text, pattern, -1), filled, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def _rest(rows: DataFrame) -> DataFrame:
    """rows with rest: the text without its base spans."""
    rows = rows.withColumn("rest", blank(F.col("text"), ASSIGN, group=2, least=ASSIGN_LEAST))
    return rows.withColumn("rest", blank(F.col("rest"), ACCESS)).withColumn("rest", blank(F.col("rest"), HEX))


def _tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution (Abramowitz and Stegun 26.2.17, absolute error below 1e-7, and Mills' ratio far out)."""

    def of(a: Column) -> Column:
        near = let(1 / (1 + 0.2316419 * a), lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
        return F.greatest(F.least(2 * density * F.when(a < 6, near).otherwise(1 / (a + 1 / a)), F.lit(1.0)), F.lit(1e-60))

    return let(F.abs(z), of)


def encoding(token: Column) -> Column:
    """The name of the alphabet that a token seems to be written in; null for words, paths and numbers, which no encoding needs."""
    one_case = token.rlike("^([0-9a-z]+|[0-9A-Z]+)$") & token.rlike("[a-zA-Z]")
    return F.when(
        token.rlike("[0-9]"),
        F.when(one_case & token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(one_case & token.rlike("^[a-zA-Z2-7]+$"), "b32")
        .when(one_case, "b36")
        .when(token.rlike("^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)$") & token.rlike("[A-Z]") & token.rlike("[a-z]"), "b64"),
    )


def _randomness(symbols: Column, alphabet: str) -> Column:
    """p-value of the hypothesis that the symbols are drawn uniformly from the alphabet."""
    k, n = len(alphabet), F.length(symbols).cast("double")
    without = lambda s, x: F.length(s) - F.length(F.replace(s, x, F.lit("")))
    squares = _sum(F.transform(F.array(*map(F.lit, alphabet)), lambda c: F.pow(without(symbols, c).cast("double"), F.lit(2.0))), 0.0)
    chi = F.pow((squares * k / n - n) / (k - 1), F.lit(1 / 3))
    z_chi = (chi - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))

    sizes = [len(c) for x in CLASSES if (c := [a for a in alphabet if a in x])]
    counts = [n - F.length(F.translate(symbols, "".join(a for a in alphabet if a in x), "")) for x in CLASSES if any(a in x for a in alphabet)]
    df = len(sizes) - 1
    by_class = sum(F.pow(c.cast("double"), F.lit(2.0)) * k / (n * size) for c, size in zip(counts, sizes, strict=True)) - n
    z_class = (F.pow(F.greatest(by_class, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p_class = let(z_class, lambda z: F.when(z > 0, _tail(z) / 2).otherwise(1 - _tail(z) / 2))

    half = F.translate(symbols, alphabet, "0" * (k // 2) + "1" * (k - k // 2))

    def runs(bits: Column) -> Column:
        ones = without(bits, F.lit("1")).cast("double")
        mean = 2 * ones * (n - ones) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        turns = (without(bits, F.lit("01")) + without(bits, F.lit("10"))) / 2
        return F.when(spread > 0, (1 + turns - mean) / F.sqrt(spread)).otherwise(F.lit(1e3))

    values = F.transform(F.split(symbols, ""), lambda c: F.instr(F.lit(alphabet), c) - (k + 1) / 2)
    serial = let(values, lambda v: _sum(F.zip_with(v, F.slice(v, F.lit(2), F.size(v)), lambda a, b: F.coalesce(a * b, F.lit(0.0))), 0.0))
    z_serial = serial / ((k * k - 1) / 12) / F.sqrt(n - 1)
    # runs of symbols of one class, which ordinary names have too few of
    square, cube = (sum((size / k) ** power for size in sizes) for power in (2, 3))
    same = n - F.regexp_count(F.translate(symbols, "".join(CLASSES), "".join(x[0] * len(x) for x in CLASSES)), F.lit(r"(.)\1*"))
    z_same = (same - (n - 1) * square) / F.sqrt((n - 1) * (square - square**2) + 2 * (n - 2) * (cube - square**2))
    x = -(F.ln(_tail(z_chi)) + F.ln(p_class) + F.ln(_tail(let(half, runs))) + F.ln(_tail(z_same)) + F.ln(_tail(z_serial)))
    return let(x, lambda y: F.exp(-y) * (1 + y + y * y / 2 + y * y * y / 6 + y * y * y * y / 24))  # chi-squared with ten degrees of freedom


def p_random(token: Column) -> Column:
    """p-value of the hypothesis that a token is random in its encoding; null without encoding."""
    bare = F.regexp_replace(token, "=+$", "")

    def by_encoding(t: Column) -> Column:
        def of(kind: Column) -> Column:
            out = F.when(kind == "b64", _randomness(F.translate(t, "-_", "+/"), ALPHABETS["b64"]))
            for name in ("hex", "b32", "b36"):
                out = out.when(kind == name, _randomness(F.lower(t), ALPHABETS[name]))
            return out

        return let(encoding(t), of)

    return let(bare, by_encoding)


def _step(p: Column, length: Column) -> Column:
    """Place of a p-value on the grid, raised by the length; higher for less random ones, null for null."""
    scaled = p * F.least(length, F.lit(FULL_LENGTH)) / BASE_LENGTH
    return F.when(p.isNotNull(), F.least(F.greatest(F.floor(-F.log10(F.least(scaled, F.lit(1.0))) * STEPS), F.lit(0)), F.lit(STEPS * POWERS))).cast("int")


def threshold(found: DataFrame, alpha: float) -> int:
    """The highest step that is claimed, from rows (h, length, step, p) of all candidates; -1 if none is.

    The distinct candidates are counted by step and length, at most
    (STEPS * POWERS + 1) * FULL_LENGTH rows, and only these come to the driver.
    """
    length = F.least("length", F.lit(FULL_LENGTH)).alias("length")
    tested = found.where("step IS NOT NULL").select("h", "step", length, (F.col("p") >= HALF).alias("high")).distinct()
    rows = tested.groupBy("step", "length").agg(F.count("*").alias("n"), F.count_if("high").alias("high")).collect()
    by_length: dict[int, int] = {}
    for r in rows:
        by_length[r["length"]] = by_length.get(r["length"], 0) + r["high"]
    counts: dict[int, int] = {}
    for r in rows:
        counts[r["step"]] = counts.get(r["step"], 0) + r["n"]
    every, high = {r["length"] for r in rows}, sum(by_length.values())
    allowance = 1 + (math.sqrt(high) + 1) / max(high, 1)  # a standard deviation and one more, so that few candidates aren't lost to chance
    limit, claimed = -1, 0
    for step in range(STEPS * POWERS):
        claimed += counts.get(step, 0)
        least = 10.0 ** (-(step + 1) / STEPS)
        # random candidates of each length, times the share of them that the step claims
        expected = sum(by_length[n] * allowance / (1 - HALF) * (1 - min(1.0, least / (n / BASE_LENGTH))) for n in every)
        if claimed and claimed - expected <= alpha * claimed:
            limit = step
    return limit


def _printed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"])), ",")


def _disjoint(chosen: Column, others: Column) -> Column:
    """The spans of chosen that overlap none of the others."""
    return F.filter(chosen, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """One row per row: doc_id, n_assign, n_access, n_hex, base_spans, spans.

    A span is kind:start:end in code points, end exclusive; spans are in order
    of start, then kind, and joined by commas.  ``spans`` has the base spans and
    those of kind ``random``, which lie outside of them: whole candidates, or
    runs of letters and digits in candidates that aren't random as a whole.

    * Null and empty texts have no spans.
    * Repeated rows are scanned alike, and a candidate counts once however often
      the corpus has it.
    * Words, dashes, numbers and paths have no encoding and are never claimed.
    * Candidates whose p-values tie share their fate.
    * Extra columns are ignored; an empty table gives an empty result.
    """
    rows = _rest(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    text, rest = F.col("text"), F.col("rest")
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))

    def tested(s: Column) -> Column:
        size = F.length(F.regexp_replace(s["value"], "=+$", ""))
        return let(p_random(s["value"]), lambda p: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("h"), size.alias("length"), p.alias("p"), _step(p, size).alias("step")))

    def candidates(pattern: str) -> Column:
        return F.when(rest.rlike(CANDIDATE), F.filter(F.transform(find(rest, pattern, "random"), tested), lambda s: s["step"].isNotNull()))

    found = rows.select(
        "doc_id",
        *(F.transform(find(text, p, k, **more), bare).alias(k) for k, p, more in (("assign", ASSIGN, {"group": 2, "least": ASSIGN_LEAST}), ("access", ACCESS, {}), ("hex", HEX, {}))),
        candidates(CANDIDATE).alias("whole"),
        candidates(INNER).alias("inner"),
    )
    found = materialise(found)  # spans only: each text is read once
    every = F.concat(*(F.coalesce(c, F.array().cast(found.schema["whole"].dataType)) for c in ("whole", "inner")))
    limit = threshold(found.select(F.explode(every).alias("c")).select("c.h", "c.length", "c.p", "c.step"), alpha)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    claimed = lambda c: F.coalesce(F.transform(F.filter(c, lambda s: s["step"] <= limit), bare), none)
    found = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex"))).withColumn("whole", claimed("whole")).withColumn("inner", claimed("inner"))
    spans = F.array_sort(F.concat("base", "whole", _disjoint(F.col("inner"), F.col("whole"))))
    counts = [F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, _printed(F.col("base")).alias("base_spans"), _printed(spans).alias("spans"))
