"""Text functions that Spark lacks, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def compatible(text: Column) -> Column:
    """The text in compatibility composition (NFKC), runs of white space as one space, trimmed; null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for t in texts.to_pylist()], pa.string())

    return run(text)


def cut(text: str | None, limit: int) -> list[str]:
    """Pieces of at most so many characters that make up the text: each ends after the last empty line within the limit, else after the last line, else at the limit."""
    out: list[str] = []
    at = 0
    while text and at < len(text):
        end = min(at + limit, len(text))
        if end < len(text):
            window = text[at:end]
            for mark in ("\n\n", "\n"):
                if (k := window.rfind(mark)) >= 0:
                    end = at + k + len(mark)
                    break
        out.append(text[at:end])
        at = end
    return out


def pieces(text: Column, limit: int = 3000) -> Column:
    """The pieces of cut as an array."""
    if limit < 1:
        raise ValueError(f"pieces of {limit} characters")

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([cut(t, limit) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)
