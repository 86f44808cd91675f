"""Counts of a run, gathered in the pass that does the work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """df that counts where each condition holds as its rows go by, and a function that gives the counts once an action has run.

    Nothing is read twice, and no cache is needed: the counts come with the
    action's own tasks.  They stand for one whole run, so an action that stops
    early (a limit) counts what it has seen.
    """
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in counts.items())), lambda: watch.get


def counted_stream(stream: DataFrame, name: str, **counts: Column) -> DataFrame:
    """A stream whose progress has the counts of each batch, under ``observedMetrics`` by name."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in counts.items()))


def progress(query, name: str) -> list[dict]:
    """Counts of each batch that a stream's query reports."""
    return [m for p in query.recentProgress if (m := (p.observedMetrics or {}).get(name)) is not None]
