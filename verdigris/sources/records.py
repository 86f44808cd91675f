"""Parsed records, reviews, claims and overlays over the stored tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.tables import table

OUTCOMES = ["supported", "partially_supported", "not_supported", "unclear"]


def _pick(options: list[str], step: int) -> Column:
    return F.get(F.array(*map(F.lit, options)), (F.floor(F.col("o_orderkey") / step) % len(options)).cast("int"))


def _sql(options: list[str], step: int) -> str:
    return f"[{', '.join(repr(o) for o in options)}][1 + (o_orderkey // {step}) % {len(options)}]"


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """What a parser made of each case: case_id, score, role, outcome (the applicant's), employee, employer, source, meta_date, text_date, kinds, conflict."""
    applicant, role = _pick(OUTCOMES, 3), _pick(["employee", "employer", "employee", "unknown"], 2)
    other = F.when(applicant == "supported", "not_supported").when(applicant == "not_supported", "supported").otherwise(applicant)
    side = lambda own: F.when((role == "unknown") | (applicant == "unclear"), "unclear").when(role == own, applicant).otherwise(other)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 101).cast("int").alias("score"), role.alias("role"), applicant.alias("outcome"), side("employee").alias("employee"), side("employer").alias("employer"),
        _pick(["registry", "upload"], 1).alias("source"), F.when(F.col("o_orderkey") % 5 != 0, day).alias("meta_date"), F.when(F.col("o_orderkey") % 7 == 0, "2023-02-31").when(F.col("o_orderkey") % 11 != 0, F.concat(F.substring(day, 1, 8), F.lit("01"))).alias("text_date"),
        F.array(F.substring("o_orderpriority", 3, 20)).alias("kinds"), F.col("o_custkey").alias("party"), F.col("o_totalprice").alias("amount"),
    )


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of every fourth case: status, and what the reviewer changed (null: nothing)."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").where(k % 4 == 0).select(
        k.alias("case_id"), F.when(k % 8 == 0, "approved").otherwise("modified").alias("status"), F.when(k % 12 == 0, _pick(OUTCOMES, 5)).alias("new_outcome"), F.when(k % 20 == 0, "not_supported").alias("new_employee"), F.when(k % 40 == 0, "supported").alias("new_employer"),
        F.when(k % 16 == 0, F.array(F.lit("REVIEWED"))).otherwise(F.array().cast("array<string>")).alias("new_kinds"),
    )


def claims(spark: SparkSession, d: str) -> DataFrame:
    """A claim for each line of a case: case_id, claim_id, kind, role, outcome, asked, awarded, provider."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    outcome = F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "R", "not_supported").when(F.col("l_linestatus") == "F", "partially_supported").otherwise("unclear")
    return table(spark, d, "lineitem").select(
        k.alias("case_id"), n.alias("claim_id"), F.get(F.array(*map(F.lit, ["wages", "overtime", "termination", "leave"])), ((k + n) % 4).cast("int")).alias("kind"), F.when((k + n) % 3 == 0, "employer").otherwise("employee").alias("role"), outcome.alias("outcome"),
        F.when(n % 5 != 0, F.col("l_extendedprice")).alias("asked"), F.when(outcome.isin("supported", "partially_supported"), F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("awarded"), F.get(F.array(*map(F.lit, ["employer", "employee", "court", "unknown"])), (F.col("l_suppkey") % 4).cast("int")).alias("provider"),
    )


_ROLE, _OUT = _sql(["employee", "employer", "employee", "unknown"], 2), _sql(OUTCOMES, 3)
PARSED = f"""p0 AS (SELECT *, {_ROLE} AS role, {_OUT} AS outcome, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
 parsed AS (SELECT o_orderkey AS case_id, (o_orderkey % 101)::INTEGER AS score, role, outcome, CASE WHEN role = 'unknown' OR outcome = 'unclear' THEN 'unclear' WHEN role = 'employee' OR outcome = 'partially_supported' THEN outcome WHEN outcome = 'supported' THEN 'not_supported' ELSE 'supported' END AS employee,
 CASE WHEN role = 'unknown' OR outcome = 'unclear' THEN 'unclear' WHEN role = 'employer' OR outcome = 'partially_supported' THEN outcome WHEN outcome = 'supported' THEN 'not_supported' ELSE 'supported' END AS employer, {_sql(["registry", "upload"], 1)} AS source, CASE WHEN o_orderkey % 5 <> 0 THEN day END AS meta_date,
 CASE WHEN o_orderkey % 7 = 0 THEN '2023-02-31' WHEN o_orderkey % 11 <> 0 THEN substring(day, 1, 8) || '01' END AS text_date, [substring(o_orderpriority, 3)] AS kinds, o_custkey AS party, o_totalprice AS amount FROM p0)"""
REVIEWS = f"""reviews AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 8 = 0 THEN 'approved' ELSE 'modified' END AS status, CASE WHEN o_orderkey % 12 = 0 THEN {_sql(OUTCOMES, 5)} END AS new_outcome, CASE WHEN o_orderkey % 20 = 0 THEN 'not_supported' END AS new_employee,
 CASE WHEN o_orderkey % 40 = 0 THEN 'supported' END AS new_employer, CASE WHEN o_orderkey % 16 = 0 THEN ['REVIEWED'] ELSE [] END AS new_kinds FROM orders WHERE o_orderkey % 4 = 0)"""
CLAIMS = """claims AS (SELECT l_orderkey AS case_id, l_linenumber AS claim_id, ['wages', 'overtime', 'termination', 'leave'][1 + (l_orderkey + l_linenumber) % 4] AS kind, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 'employer' ELSE 'employee' END AS role,
 CASE WHEN l_returnflag = 'A' THEN 'supported' WHEN l_returnflag = 'R' THEN 'not_supported' WHEN l_linestatus = 'F' THEN 'partially_supported' ELSE 'unclear' END AS outcome, CASE WHEN l_linenumber % 5 <> 0 THEN l_extendedprice END AS asked,
 CASE WHEN l_returnflag = 'A' OR (l_returnflag <> 'R' AND l_linestatus = 'F') THEN l_extendedprice * (1 - l_discount) END AS awarded, ['employer', 'employee', 'court', 'unknown'][1 + l_suppkey % 4] AS provider FROM lineitem)"""
