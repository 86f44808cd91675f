"""Records built from a parser's result and its review, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.dates import calendar_date


def reviewed_sides(applicant_role: Column, employee: Column, employer: Column, new_employee: Column, new_employer: Column) -> tuple[Column, Column]:
    """Outcomes of both sides after review: two new ones replace both; one alone fills an unclear side, unless both sides would then have won or lost."""
    clash = lambda new, other: new.isin("supported", "not_supported") & (new == other)
    one = lambda new, old, other: F.when(new.isNotNull() & (old == "unclear") & ~clash(new, other), new).otherwise(old)
    both = new_employee.isNotNull() & new_employer.isNotNull()
    return F.when(both, new_employee).otherwise(one(new_employee, employee, employer)), F.when(both, new_employer).otherwise(one(new_employer, employer, employee))


def confidence(status: Column, score: Column) -> Column:
    """1 for approved records, 0.95 for modified ones, else by the score between 0.4 and 0.92."""
    return F.when(status == "approved", 1.0).when(status == "modified", 0.95).otherwise(F.least(F.greatest(F.round(score.cast("decimal(10,0)") * F.lit("0.009").cast("decimal(4,3)"), 2).cast("double"), F.lit(0.4)), F.lit(0.92)))


def authoritative_date(source: Column, meta: Column, text: Column) -> Column:
    """The first valid date: of the metadata first where the source keeps good ones, of the text first otherwise."""
    a, b = calendar_date(meta), calendar_date(text)
    return F.when(source == "registry", F.coalesce(a, b)).otherwise(F.coalesce(b, a))


def in_analysis_set(status: Column, score: Column) -> Column:
    return F.coalesce(status == "approved", F.lit(False)) | (score >= 80)


def analysis_records(parsed: DataFrame, reviews: DataFrame) -> DataFrame:
    """A record for each parsed case, the review's values over the parser's where it has some; cases without a review stay."""
    rows = parsed.join(reviews, "case_id", "left")
    c = F.col
    employee, employer = reviewed_sides(c("role"), c("employee"), c("employer"), c("new_employee"), c("new_employer"))
    kept = in_analysis_set(c("status"), c("score"))
    return rows.select(
        "case_id", F.coalesce("new_outcome", "outcome").alias("outcome"), employee.alias("employee"), employer.alias("employer"), F.when(F.size("new_kinds") > 0, c("new_kinds")).otherwise(c("kinds")).alias("kinds"), authoritative_date(c("source"), c("meta_date"), c("text_date")).alias("date"),
        confidence(c("status"), c("score")).alias("confidence"), kept.alias("included"), F.when(~kept, "score_below_80").alias("filter_reason"), c("status").isNotNull().alias("has_review"), "score", "role",
    )


def legacy_outcome(outcome: Column, role: Column) -> Column:
    """The four legacy classes, seen from the employer."""
    won, lost = F.when(role == "employee", "用人单位败诉").otherwise("用人单位胜诉"), F.when(role == "employee", "用人单位胜诉").otherwise("用人单位败诉")
    return F.when(role == "unknown", "调解/其他").when(outcome == "supported", won).when(outcome == "not_supported", lost).when(outcome == "partially_supported", "部分支持").otherwise("调解/其他")


def overlay(df: DataFrame, patches: DataFrame, keys: list[str], columns: list[str], *order: str) -> DataFrame:
    """df with the newest patch of each key laid over it: a patch's columns where they aren't null."""
    newest = patches.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_p"))
    out = df.join(newest, keys, "left")
    return out.select(*(F.coalesce(F.col("_p")[c], df[c]).alias(c) if c in columns else F.col(c) for c in df.columns))


def benchmark_verdict(*, gold: Column, predicted: Column, technical: Column, mismatch: Column) -> Column:
    """What a prediction is worth against gold: failures and mistaken identities come first, then what is unclear, then right and wrong."""
    return F.when(technical, "technical").when(mismatch, "identity").when(gold == "unclear", "unclear_gold").when(predicted == "unclear", "unresolved").when(predicted == gold, "correct").otherwise("incorrect")
