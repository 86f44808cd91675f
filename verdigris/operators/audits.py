"""Audits of what was found: coverage of outcomes and its risks, and guardrails of a run's quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import court_tables as c

# Where a sample is small, and from which share on unknown outcomes are many.
SMALL_SAMPLE, MANY_UNKNOWN = 30, 0.1
OUTCOMES = ("supported", "partially_supported", "not_supported", "unclear")
UNCLASSIFIED = "未分类诉求"


def _kind(claim: Column) -> Column:
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(some(claim["type"]), some(claim["name"]), F.lit(UNCLASSIFIED))


def outcome_audit(cases: DataFrame) -> DataFrame:
    """section, key, n, needs_review, share of a table of cases with claims and diagnostics, as ``judgments.read`` gives them.

    Sections: total (cases, claims, resolved, unclear, needs_review, review_items),
    outcome (all four, found or not), reason, claim_type, suggestion.  share is a
    percentage with one decimal: of claims for totals and outcomes, of review items
    for reasons and suggestions, of the type's claims that are unclear for types; 0
    where there is nothing.  A claim needs review if an item names it, or names no
    claim but its type.

    One pass: each case gives the few rows that it adds to, which are summed where
    they are before a shuffle of one row for each section and key.
    """
    diagnostics = F.coalesce("diagnostics", F.array().cast(cases.schema["diagnostics"].dataType))
    claims = F.coalesce("claims", F.array().cast(cases.schema["claims"].dataType))
    rows = cases.select(claims.alias("claims"), diagnostics.alias("items"))

    def entry(section: str, key: Column, review: Column | None = None, unclear: Column | None = None, n: Column | None = None) -> Column:
        number = lambda x: (F.lit(0) if x is None else x).cast("long")
        return F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"), (F.lit(1) if n is None else n).cast("long").alias("n"), number(review).alias("needs_review"), number(unclear).alias("unclear"))

    def reviewed(x: Column) -> Column:
        return F.exists("items", lambda i: F.coalesce(i["claim_id"] == x["id"], F.lit(False)) | (i["claim_id"].isNull() & F.coalesce(i["claim_type"] == x["type"], F.lit(False))))

    outcome = lambda x: F.coalesce(x["outcome"], F.lit("unclear"))
    of_claim = F.transform("claims", lambda x: F.struct(_kind(x).alias("kind"), outcome(x).alias("outcome"), reviewed(x).alias("review")))
    rows = rows.select(of_claim.alias("claims"), "items")
    unclear = lambda x: x["outcome"] == "unclear"
    count = lambda cond: F.size(F.filter("claims", cond))
    entries = F.concat(
        F.array(
            entry("total", F.lit("cases")), entry("total", F.lit("claims"), n=F.size("claims")), entry("total", F.lit("resolved"), n=count(lambda x: ~unclear(x))), entry("total", F.lit("unclear"), n=count(unclear)),
            entry("total", F.lit("needs_review"), n=count(lambda x: x["review"])), entry("total", F.lit("review_items"), n=F.size("items")), *(entry("outcome", F.lit(o), n=F.lit(0)) for o in OUTCOMES),
        ),
        F.transform("claims", lambda x: entry("outcome", x["outcome"], x["review"].cast("int"))),
        F.transform("claims", lambda x: entry("claim_type", x["kind"], x["review"].cast("int"), unclear(x).cast("int"))),
        F.transform("items", lambda i: entry("reason", F.coalesce(i["reason"], F.lit("unknown")))),
        F.filter(F.transform("items", lambda i: entry("suggestion", i["suggestion"])), lambda e: e["key"].isNotNull()),
    )
    sums = rows.select(F.explode(entries).alias("e")).groupBy("e.section", "e.key").agg(F.sum("e.n").alias("n"), F.sum("e.needs_review").alias("needs_review"), F.sum("e.unclear").alias("unclear"))
    # what follows has a row for each section and key
    everything = Window.partitionBy(F.lit(0))
    total = lambda key: F.max(F.when((F.col("section") == "total") & (F.col("key") == key), F.col("n"))).over(everything)
    part, whole = F.when(F.col("section") == "claim_type", F.col("unclear")).otherwise(F.col("n")), F.when(F.col("section").isin("reason", "suggestion"), F.col("items")).when(F.col("section") == "claim_type", F.col("n")).otherwise(F.col("all"))
    out = sums.withColumns({"all": total("claims"), "items": total("review_items")})
    share = F.when((whole > 0) & ~F.col("key").isin("cases", "review_items"), F.floor(part / whole * 1000 + 0.5) / 10).otherwise(0.0)
    return out.select("section", "key", "n", "needs_review", share.alias("share"))


def amount_risks(cases: DataFrame) -> DataFrame:
    """case_id, claim_id, type, name, asked, awarded: claims of money granted in full although less is awarded than asked."""
    rows = cases.select("case_id", F.explode("claims").alias("x"))
    x = F.col("x")
    risky = x["type"].isin(*c.MONETARY) & (x["outcome"] == "supported") & (x["awarded"] > 0) & (x["awarded"] < x["asked"])
    return rows.where(risky).select("case_id", x["id"].alias("claim_id"), _kind(x).alias("type"), x["name"].alias("name"), x["asked"].alias("asked"), x["awarded"].alias("awarded"))


def run_quality(inputs: DataFrame, *, run: str, available: Column, eligible: Column, outcome: str, stratum: str | None = None, balanced: Column | None = None) -> DataFrame:
    """By run: expected, available, missing, included, excluded, unknown, coverage, unknown_rate, issues and status.

    inputs has a row for each case that a run was to analyse; ``available`` says
    whether its record is there, ``eligible`` whether it may be counted.  Issues, in
    this order: MISSING_ANALYSIS_RECORDS; EMPTY_ANALYSIS_INPUT (an error) or
    NO_ANALYTICS_ELIGIBLE_RECORDS; SMALL_SAMPLE; HIGH_UNKNOWN_OUTCOME_RATE;
    BALANCED_SAMPLE_NOT_POPULATION_REPRESENTATIVE; and for strata
    STRATUM_MISSING_AFTER_PROCESSING and STRATUM_ATTRITION with their number.
    Rates are 0 where nothing is expected.  Two aggregates, by stratum and by run.
    """
    there = F.coalesce(available, F.lit(False))
    counted = there & F.coalesce(eligible, F.lit(False))
    rows = inputs.select(F.col(run).alias("run"), (F.col(stratum) if stratum else F.lit(None).cast("string")).alias("stratum"), there.alias("there"), counted.alias("counted"), (counted & (F.col(outcome) == "unclear")).alias("unknown"), (balanced if balanced is not None else F.lit(False)).alias("balanced"))
    strata = rows.groupBy("run", "stratum").agg(F.count("*").alias("expected"), F.count_if("there").alias("available"), F.count_if("counted").alias("included"), F.count_if("unknown").alias("unknown"), F.bool_or("balanced").alias("balanced"))
    lost, thinned = F.col("available") == 0, (F.col("available") > 0) & (F.col("available") < F.col("expected"))
    runs = strata.groupBy("run").agg(*(F.sum(k).alias(k) for k in ("expected", "available", "included", "unknown")), F.bool_or("balanced").alias("balanced"), F.count_if(lost).alias("lost"), F.count_if(thinned).alias("thinned"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    runs = runs.withColumns({"missing": F.col("expected") - F.col("available"), "excluded": F.col("available") - F.col("included"), "coverage": ratio("available", "expected"), "unknown_rate": ratio("unknown", "included")})
    col = F.col
    empty = col("available") == 0
    checks = [
        ("MISSING_ANALYSIS_RECORDS", col("missing") > 0), ("EMPTY_ANALYSIS_INPUT", empty), ("NO_ANALYTICS_ELIGIBLE_RECORDS", ~empty & (col("included") == 0)), ("SMALL_SAMPLE", (col("included") > 0) & (col("included") < SMALL_SAMPLE)),
        ("HIGH_UNKNOWN_OUTCOME_RATE", col("unknown_rate") > MANY_UNKNOWN), ("BALANCED_SAMPLE_NOT_POPULATION_REPRESENTATIVE", col("balanced")),
    ]
    issues = [F.when(bad, F.lit(name)) for name, bad in checks]
    if stratum:
        issues += [F.when(col(k) > 0, F.concat(F.lit(f"{name}:"), col(k).cast("string"))) for name, k in (("STRATUM_MISSING_AFTER_PROCESSING", "lost"), ("STRATUM_ATTRITION", "thinned"))]
    found = F.array_compact(F.array(*issues))
    status = F.when(empty, "blocked").when(F.size(found) > 0, "warning").otherwise("pass")
    return runs.select(col("run").alias(run), "expected", "available", "missing", "included", "excluded", "unknown", F.round("coverage", 4).alias("coverage"), F.round("unknown_rate", 4).alias("unknown_rate"), F.array_join(found, ",").alias("issues"), status.alias("status"))
