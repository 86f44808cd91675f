"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_TAGS = "p|div|br|li|tr|h1|h2|h3|h4|h5|h6"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def clean_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags go, block ends become line ends, common entities are decoded."""
    out = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, f"(?i)</?({BLOCK_TAGS})( [^>]*)?/?>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", "")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def normalise_blanks(text: Column) -> Column:
    """One blank for runs of blanks (no-break and ideographic ones too), \\n for \\r\\n, straight quotes, at most one empty line in a row."""
    out = F.regexp_replace(text, "[ \\t\u00a0\u3000]+", " ")
    out = F.translate(F.regexp_replace(out, "\\r\\n?", "\n"), "\u201c\u201d\u2018\u2019", "\"\"''")
    return F.regexp_replace(out, "\\n{3,}", "\n\n")


def paragraphs(text: Column) -> Column:
    """Trimmed lines that have a character."""
    return F.filter(F.transform(F.split(text, "\n+"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with its ASCII white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(text, "[ \\t-\\r]+", " ")), 256)


def terms(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def char_ngrams(text: Column, sizes: tuple[int, ...] = (2, 3), whole_up_to: int = 4) -> Column:
    """Segments of up to ``whole_up_to`` characters whole, longer ones as all windows of the sizes."""
    n = F.length(text)

    def windows(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, F.lit(k)))

    grams = F.flatten(F.array(*map(windows, sizes)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= whole_up_to, F.array(text)).otherwise(grams)


def without_repeats(lines: Column, least: int = 5) -> Column:
    """Lines without those longer than ``least`` that equal the line before."""
    return F.filter(F.transform(lines, lambda x, i: F.when((i > 0) & (F.length(x) > least) & (x == F.get(lines, i - 1)), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())


def redact(text: Column, clip: int = 500) -> Column:
    """Keys and bearer tokens masked, and the rest clipped."""
    out = F.regexp_replace(text, "(?i)bearer +[a-z0-9._-]+", "Bearer [redacted]")
    out = F.regexp_replace(out, "(?i)(api[_-]?key|token|secret|password)([\"']? *[:=] *[\"']?)[a-z0-9._-]{6,}", "$1$2[redacted]")
    return F.substring(out, 1, clip)


def matches_query(query: str, *columns: Column) -> Column:
    """A keyword query over several columns: `` AND `` wins over `` OR ``; otherwise the whole string is one keyword."""
    hay = F.lower(F.concat_ws(" ", *columns))
    for word, join in ((" AND ", lambda a, b: a & b), (" OR ", lambda a, b: a | b)):
        if word in query:
            out = None
            for part in (p.strip().lower() for p in query.split(word)):
                hit = F.contains(hay, F.lit(part))
                out = hit if out is None else join(out, hit)
            return out
    return F.contains(hay, F.lit(query.strip().lower()))


def either_contains(a: Column, b: Column) -> Column:
    """Whether one text contains the other; nulls are empty, and an empty text is contained in all."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.contains(a, b) | F.contains(b, a)
