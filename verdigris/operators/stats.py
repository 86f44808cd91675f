"""Aggregates over records: outcome statistics, distributions, bands, rates and audits.

All of them are one partial and one final aggregation; none gathers the rows of
a group.  Which ids stand behind a count is another table (``traceback``), so a
group that holds a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.rates import outcome_counts, percent, percent_of_1000


def outcome_stats(df: DataFrame, outcome: str, *by: str) -> DataFrame:
    """Counts of each outcome by group, with win and partial rates over known outcomes (null if none is known)."""
    out = df.groupBy(*by).agg(F.count("*").alias("total"), *outcome_counts(F.col(outcome)))
    return out.select("*", percent(F.col("supported"), F.col("known")).alias("win_rate"), percent(F.col("partially_supported"), F.col("known")).alias("partial_rate"))


def traceback(df: DataFrame, outcome: str, id_col: str, *by: str) -> DataFrame:
    """The ids behind outcome_stats, a row for each."""
    return df.where(F.col(outcome).isNotNull()).select(*by, outcome, id_col)


def with_scope(stats: DataFrame, scope: DataFrame, on: str) -> DataFrame:
    """stats with a row for every member of scope: zero counts and null rates where nothing was found."""
    out = scope.select(on).distinct().join(stats, on, "left")
    return out.fillna(0, [c for c, t in stats.dtypes if t in ("bigint", "int") and c != on])


def distribution(df: DataFrame, value: Column | str, name: str, total: int | None = None) -> DataFrame:
    """Rows by value, with the share of all rows in percent."""
    counts = df.groupBy((F.col(value) if isinstance(value, str) else value).alias(name)).agg(F.count("*").alias("n"))
    whole = F.lit(total) if total is not None else F.sum("n").over(Window.partitionBy())
    return counts.select(name, "n", percent(F.col("n"), whole, none=0.0).alias("share"))


def array_distribution(df: DataFrame, array: str, name: str) -> DataFrame:
    """Rows that have each element of an array column, with their share of all rows in percent."""
    total = df.count()
    found = df.select(F.explode(F.array_distinct(F.col(array))).alias(name))
    return found.groupBy(name).agg(F.count("*").alias("n")).select(name, "n", percent(F.col("n"), F.lit(total), none=0.0).alias("share"))


def marginals(df: DataFrame, *dims: str, missing: str = "unknown") -> DataFrame:
    """The distribution of each dimension alone, in one pass: dimension, value, n; null and empty values are ``missing``."""
    clean = df.select(*(F.coalesce(F.nullif(F.trim(F.col(d).cast("string")), F.lit("")), F.lit(missing)).alias(d) for d in dims))
    sets = clean.groupingSets([[F.col(d)] for d in dims], *(F.col(d) for d in dims)).agg(F.count("*").alias("n"))
    which = [F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims]
    return sets.select(F.coalesce(*which).alias("dimension"), F.coalesce(*(F.col(d) for d in dims)).alias("value"), "n")


def score_bands(df: DataFrame, score: str, bands: dict[str, float], lowest: str) -> DataFrame:
    """Rows by band, the bands given with their least score."""
    out = None
    for name, least in sorted(bands.items(), key=lambda x: -x[1]):
        out = F.when(F.col(score) >= least, name) if out is None else out.when(F.col(score) >= least, name)
    return distribution(df, out.otherwise(lowest), "band")


def fill_rates(df: DataFrame, *fields: str) -> DataFrame:
    """For each field the share of rows that have a value, the worst first when ordered by share: field, n, filled, share."""
    present = [F.count_if(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).isNotNull()).alias(f) for f in fields]
    one = df.agg(F.count("*").alias("n"), *present)
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields))).alias("r")
    return one.select("n", rows).select("r.field", "n", "r.filled", percent(F.col("r.filled"), F.col("n"), none=0.0).alias("share"))


def prevalence(df: DataFrame, id_col: str, item: str, within: Column) -> DataFrame:
    """Items by the number of cases within a population that have them; the denominator is the whole population."""
    cases = df.where(within)
    total = cases.agg(F.count_distinct(id_col)).first()[0]
    counts = cases.where(F.col(item).isNotNull()).groupBy(item).agg(F.count_distinct(id_col).alias("cases"))
    return counts.select(item, "cases", F.lit(total).cast("long").alias("population"), percent(F.col("cases"), F.lit(total), none=0.0).alias("prevalence"))


def funnel(df: DataFrame, **layers: Column) -> DataFrame:
    """Rows that pass each layer and all before it, with the rate against the layer before: layer, position, n, rate."""
    names, passed, counts = list(layers), F.lit(True), []
    for name in names:
        passed = passed & F.coalesce(layers[name], F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    one = df.agg(*counts)
    rows = [F.struct(F.lit(n).alias("layer"), F.lit(k).alias("position"), F.col(n).alias("n"), percent(F.col(n), F.col(names[k - 1]) if k else F.col(n), none=0.0).alias("rate")) for k, n in enumerate(names)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def coverage_audit(df: DataFrame, outcome: str, reason: str) -> DataFrame:
    """Rows by outcome and by reason, with percentages of all: kind, value, n, share."""
    long = df.select(F.explode(F.array(F.struct(F.lit("outcome").alias("kind"), F.col(outcome).alias("value")), F.struct(F.lit("reason").alias("kind"), F.col(reason).alias("value")))).alias("x"))
    counts = long.where("x.value IS NOT NULL").groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
    total = df.count()
    return counts.select("kind", "value", "n", percent_of_1000(F.col("n"), F.lit(total)).alias("share"))


def guardrails(df: DataFrame, outcome: str, *by: str, small: int = 30, unknown: float = 0.10) -> DataFrame:
    """Issues of each group's sample: SMALL_SAMPLE under so many rows, HIGH_UNKNOWN_RATE above such a share; status is warning if any."""
    stats = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(outcome) == "unclear").alias("unknown"))
    issues = F.array_compact(F.array(F.when(F.col("n") < small, "SMALL_SAMPLE"), F.when(F.col("unknown") / F.col("n") > unknown, "HIGH_UNKNOWN_RATE")))
    return stats.select(*by, "n", "unknown", F.array_join(issues, ",").alias("issues"), F.when(F.size(issues) > 0, "warning").otherwise("pass").alias("status"))


def agreement(df: DataFrame, gold: Column, predicted: Column, *by: str) -> DataFrame:
    """Coverage, accuracy and correction rate of predictions against gold labels; rates are 0 where nothing counts. A rollup over ``by``."""
    correct, definite = gold == predicted, predicted.isNotNull()
    source = df.where(gold.isNotNull())
    grouped = source.rollup(*by) if by else source.groupBy()
    out = grouped.agg(F.count("*").alias("eligible"), F.count_if(definite).alias("definite"), F.count_if(definite & correct).alias("correct"), F.count_if(definite & ~correct).alias("incorrect"))
    return out.select(*by, "eligible", "definite", "correct", "incorrect", percent(F.col("definite"), F.col("eligible"), none=0.0).alias("coverage"), percent(F.col("correct"), F.col("definite"), none=0.0).alias("accuracy"), percent(F.col("correct"), F.col("eligible"), none=0.0).alias("end_to_end"))
