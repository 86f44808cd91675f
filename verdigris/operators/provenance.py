"""Identity, provenance and review of claims and runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence from which a candidate is accepted, and from which a reviewer sees it.
ACCEPTED, HUMAN_REVIEW = 0.80, 0.70


def chain(*parts: Column) -> Column:
    """SHA-256 of parts as a JSON array: each link of a chain takes the one before as its first part."""
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256)


def identity_status(stored: Column, current: Column) -> Column:
    return F.when(current.isNull(), "identity_missing").when(stored.isNull(), "legacy_unverified").when(stored == current, "verified").otherwise("identity_mismatch")


def changes(left: DataFrame, right: DataFrame, on: list[str], fields: dict[str, list[str]]) -> DataFrame:
    """A boolean for each name: whether any of its fields differs between two runs; nulls are values."""
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on])
    out = []
    for name, columns in fields.items():
        same = F.lit(True)
        for c in columns:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        out.append((~same).alias(name))
    return both.select(*(F.col(f"a.{k}") for k in on), *out)


def issues(**tests: Column) -> Column:
    """The names of the tests that hold, in order; a null test doesn't hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items())))


def decision(reasons: Column, confidence: Column) -> Column:
    """rejected with any reason or a low confidence, human_review below the upper threshold, else accepted."""
    return F.when((F.size(reasons) > 0) | (confidence < HUMAN_REVIEW), "rejected").when(confidence < ACCEPTED, "human_review").otherwise("accepted")


def gated(records: DataFrame, reasons: Column, analyse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The analysis of the records without a reason against them, and the blocked ones by reason."""
    marked = records.withColumn("_reasons", reasons)
    blocked = marked.select(F.explode("_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return analyse(marked.where(F.size("_reasons") == 0).drop("_reasons")), blocked


def rebind(df: DataFrame, stored: str, current: str) -> DataFrame:
    """df with the current identity bound where none was stored, a mismatch left alone, and history: what was bound before."""
    status = identity_status(F.col(stored), F.col(current))
    out = df.withColumn("status", status).withColumn("history", F.when(F.col(stored).isNotNull() & (F.col(stored) != F.col(current)), F.array(stored)).otherwise(F.array().cast("array<string>")))
    return out.withColumn("bound", F.coalesce(stored, current))
