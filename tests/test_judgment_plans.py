"""The judgments are read once, in one pass in Python, with what a query wants of them and no more."""

import pytest
from pyspark.sql import functions as F

from verdigris.operators import judgments
from verdigris.plans import registry

SF = "/root/testdata/sf0.001"


def evaluations(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return sum("ArrowEvalPython" in line for line in plan), [line for line in plan if "Filter" in line and ("transform(" in line or "lambda" in line)]


@pytest.mark.parametrize("name", ["a26_outcome_audit", "t28_case_outcomes", "t33_reference_sets", "a26_amount_risks", "t20_claim_provenance", "t21_addressed_orders", "t27_case_diagnoses"])
def test_texts_are_read_once(spark, name):
    calls, filters = evaluations(registry.queries()[name](spark, SF))
    assert calls == 1
    assert filters == []


def test_only_what_is_wanted_is_there(spark):
    df = judgments.read(spark.createDataFrame([("a", "原告：张某。被告：甲有限公司。判决如下：被告支付原告加班工资5元。")], "case_id string, text string"), ("orders",))
    assert df.columns == ["case_id", "text", "orders"]
    assert [o["type"] for o in df.first()["orders"]] == ["overtime_pay"]


def test_the_name_next_to_a_payment_that_ends_its_clause(spark):
    """As in SQL: both names begin at the same place, so the party that is named first gets it."""
    text = "原告：张某。被告：张某有限公司。判决如下：张某有限公司支付5元。"
    df = judgments.read(spark.createDataFrame([("a", text)], "case_id string, text string"))
    assert df.select(F.col("orders")[0]["target"]).first()[0] == "plaintiff"


@pytest.mark.parametrize("text", ["原告：张某。被告：甲有限公司。原告请求支付加班工资10000元。判决如下：驳回原告加班工资请求。", "", None])
def test_a_text_among_many_is_read_as_by_itself(spark, text):
    many = judgments.read(spark.createDataFrame([(i, text) for i in range(50)], "case_id int, text string"))
    one = judgments.read(spark.createDataFrame([(0, text)], "case_id int, text string"))
    assert {r["claims"].__repr__() for r in many.collect()} == {one.first()["claims"].__repr__()}
