"""Filters, gates, pages and source precedence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facets(df: DataFrame, *, equal: dict | None = None, contains: dict | None = None, among: dict | None = None, least: dict | None = None) -> DataFrame:
    """Rows that meet all facets that are set; a value of None sets none. Plain comparisons, which reach the Parquet reader."""
    for tests, test in ((equal, lambda c, v: c == v), (contains, lambda c, v: F.contains(c, F.lit(v))), (among, lambda c, v: c.isin(v)), (least, lambda c, v: c >= v)):
        for name, value in (tests or {}).items():
            if value is not None:
                df = df.where(test(F.col(name), value))
    return df


def canonical(value: Column, patterns: dict[str, str], other: str = "unknown") -> Column:
    """The name of the first pattern found in the value."""
    names = list(patterns)
    out = F.when(value.rlike(patterns[names[0]]), names[0])
    for n in names[1:]:
        out = out.when(value.rlike(patterns[n]), n)
    return out.otherwise(other)


def between_days(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows whose time lies between two days, both included."""
    return df.where((F.col(column) >= F.to_timestamp_ntz(F.lit(first))) & (F.col(column) < F.to_timestamp_ntz(F.lit(last)) + F.expr("INTERVAL 1 DAY")))


def gate(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """df with reasons (the names of the conditions that hold, in order) and status: eligible without any, else blocked."""
    found = F.array_compact(F.array(*(F.when(c, n) for n, c in reasons.items())))
    return df.withColumn("reasons", found).withColumn("status", F.when(F.size("reasons") == 0, "eligible").otherwise("blocked"))


def first_source(base: DataFrame, key: str, sources: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """key, source, value: the value of the first source that has one for the key. Sources have unique keys."""
    out, found = base.select(key), {}
    for k, (name, rows) in enumerate(sources.items()):
        out = out.join(rows.select(F.col(key), F.col(value).alias(f"_v{k}")), key, "left")
        found[name] = F.col(f"_v{k}")
    return out.select(key, F.coalesce(*(F.when(v.isNotNull(), F.lit(n)) for n, v in found.items())).alias("source"), F.coalesce(*found.values()).alias(value))


def amount_conflict(requested: Column, awarded: Column) -> Column:
    """Something was awarded, but less than requested."""
    return (awarded > 0) & (requested > awarded)


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """One page of the ordered rows; a number beyond the last page gives the last, below the first the first."""
    last = max(1, math.ceil(df.count() / size))
    return df.orderBy(*order).offset((min(max(number, 1), last) - 1) * size).limit(size)
