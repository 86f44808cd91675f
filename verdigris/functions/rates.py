"""Rates over known outcomes, with the rounding of the statistics that use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOMES = ["supported", "partially_supported", "not_supported", "unclear"]


def percent(part: Column, whole: Column, digits: int = 1, none: float | None = None) -> Column:
    """part / whole as a percentage; ``none`` where whole is 0."""
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(F.lit(none).cast("double"))


def percent_of_1000(part: Column, whole: Column) -> Column:
    """A percentage rounded as whole thousandths first; 0 where whole is 0."""
    return F.when(whole > 0, F.round(part / whole * 1000) / 10).otherwise(F.lit(0.0))


def outcome_counts(outcome: Column) -> list[Column]:
    """A conditional count for each outcome, and the number of known ones."""
    known = F.count_if(outcome.isin(OUTCOMES[:3]))
    return [*(F.count_if(outcome == o).alias(o) for o in OUTCOMES), known.alias("known")]


def merged_outcome(outcomes: Column, policy: str = "ignore_unclear") -> Column:
    """One outcome for an array of them.

    Any partial one, or both supported and not supported ones, give partial;
    else supported, else not supported.  An unclear one among others counts
    for nothing under ``ignore_unclear`` and for all under ``any_unclear``.
    """
    has = lambda o: F.array_contains(outcomes, o)
    clear = F.when(has("partially_supported") | (has("supported") & has("not_supported")), "partially_supported").when(has("supported"), "supported").when(has("not_supported"), "not_supported").otherwise("unclear")
    return F.when(has("unclear"), "unclear").otherwise(clear) if policy == "any_unclear" else clear


def complement(outcome: Column) -> Column:
    """The other side's outcome: won and lost change places, all else stays."""
    return F.when(outcome == "supported", "not_supported").when(outcome == "not_supported", "supported").otherwise(outcome)
