"""Audits on cases with known figures: coverage of outcomes, amount risks, guardrails of runs."""

from pyspark.sql import functions as F

from verdigris.operators import audits

SCHEMA = "case_id string, claims array<struct<id:string,name:string,type:string,outcome:string,asked:double,awarded:double>>, diagnostics array<struct<target:string,claim_id:string,claim_type:string,reason:string,suggestion:string>>"
CASES = [
    ("case-a", [("a1", "经济补偿金", "economic_compensation", "supported", None, None), ("a2", "未签劳动合同二倍工资", "double_wage", "unclear", None, None)], [("claim", "a2", "double_wage", "payment_beneficiary_unclear", "manual_review")]),
    ("case-b", [("b1", "经济补偿金", "economic_compensation", "partially_supported", None, None)], [("claim", "b1", "economic_compensation", "amount_conflict", "manual_review")]),
]


def test_outcome_audit(spark):
    got = {(r["section"], r["key"]): (r["n"], r["needs_review"], r["share"]) for r in audits.outcome_audit(spark.createDataFrame(CASES, SCHEMA)).collect()}
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "total"} == {"cases": 2, "claims": 3, "resolved": 2, "unclear": 1, "needs_review": 2, "review_items": 2}
    assert got["total", "unclear"][2] == 33.3 and got["total", "needs_review"][2] == 66.7
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "outcome"} == {"supported": 1, "partially_supported": 1, "not_supported": 0, "unclear": 1}
    assert got["reason", "amount_conflict"] == (1, 0, 50.0)
    assert got["claim_type", "economic_compensation"] == (2, 1, 0.0) and got["claim_type", "double_wage"] == (1, 1, 100.0)
    assert got["suggestion", "manual_review"] == (2, 0, 100.0)


def test_items_without_a_claim_name_a_type_and_nulls_count_nothing(spark):
    rows = [("a", [("a1", "x", "t1", "supported", None, None), ("a2", "y", " ", None, None, None), ("a3", " ", None, "unclear", None, None)], [("employee", None, "t1", "r", None), ("applicant", None, None, None, "manual_review")]), ("b", None, None)]
    got = {(r["section"], r["key"]): (r["n"], r["needs_review"], r["share"]) for r in audits.outcome_audit(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["total", "cases"][0] == 2 and got["total", "needs_review"][0] == 1 and got["outcome", "unclear"][0] == 2
    assert got["claim_type", "y"][0] == 1 and got["claim_type", audits.UNCLASSIFIED][0] == 1
    assert got["reason", "unknown"] == (1, 0, 50.0) and ("suggestion", None) not in got
    empty = audits.outcome_audit(spark.createDataFrame([], SCHEMA)).collect()
    assert all(r["n"] == 0 and r["share"] == 0 for r in empty)


def test_amount_risks(spark):
    rows = [("a", [(str(i), "n", kind, outcome, asked, awarded) for i, (kind, outcome, asked, awarded) in enumerate([("overtime_pay", "supported", 10.0, 5.0), ("overtime_pay", "supported", 10.0, 10.0), ("overtime_pay", "supported", 10.0, 0.0), ("overtime_pay", "partially_supported", 10.0, 5.0), ("nursing_fee", "supported", 10.0, 5.0), ("bonus", "supported", None, 5.0)])], None)]
    assert [r["claim_id"] for r in audits.amount_risks(spark.createDataFrame(rows, SCHEMA)).collect()] == ["0"]


def test_run_quality(spark):
    rows = [("good", "s1", True, True, "supported")] * 40 + [("few", "s1", True, True, "supported")] * 5 + [("gone", "s1", False, True, "supported")] * 3 + [("shut", "s1", True, False, "supported")] * 40
    rows += [("mixed", "s1", True, True, "unclear")] * 5 + [("mixed", "s1", True, True, "supported")] * 35 + [("mixed", "s2", False, True, None)] * 4 + [("mixed", "s3", False, True, None), ("mixed", "s3", True, True, "supported"), ("mixed", "s3", None, None, None)]
    df = spark.createDataFrame(rows, "run string, stratum string, there boolean, ok boolean, outcome string")
    got = {r["run"]: r for r in audits.run_quality(df, run="run", stratum="stratum", available=F.col("there"), eligible=F.col("ok"), outcome="outcome", balanced=F.col("run") == "good").collect()}
    assert (got["good"]["issues"], got["good"]["status"]) == ("BALANCED_SAMPLE_NOT_POPULATION_REPRESENTATIVE", "warning")
    assert (got["few"]["issues"], got["few"]["status"]) == ("SMALL_SAMPLE", "warning")
    assert (got["gone"]["issues"], got["gone"]["status"], got["gone"]["coverage"]) == ("MISSING_ANALYSIS_RECORDS,EMPTY_ANALYSIS_INPUT,STRATUM_MISSING_AFTER_PROCESSING:1", "blocked", 0.0)
    assert (got["shut"]["issues"], got["shut"]["excluded"], got["shut"]["unknown_rate"]) == ("NO_ANALYTICS_ELIGIBLE_RECORDS", 40, 0.0)
    m = got["mixed"]
    assert m["issues"] == "MISSING_ANALYSIS_RECORDS,HIGH_UNKNOWN_OUTCOME_RATE,STRATUM_MISSING_AFTER_PROCESSING:1,STRATUM_ATTRITION:1"
    assert (m["expected"], m["available"], m["missing"], m["included"], m["unknown"], m["unknown_rate"]) == (47, 41, 6, 41, 5, round(5 / 41, 4))
