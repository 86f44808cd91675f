"""Tokens and evidence of award texts in batches."""

import pyarrow as pa
import pytest

from verdigris.functions import awards
from verdigris.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["t09_tokens", "t25_evidence_providers"])
def test_texts_are_taken_by_the_batch(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan


def test_tokens_of_a_run():
    assert awards.tokens("违法解除加班工资加班工资甲乙") == ("违法解除", "加班工资", "加班工资", "甲乙")
    assert awards.tokens("12345") == ("12", "23", "34", "45", "123", "234", "345")
    assert awards.tokens("辞退") == ("违法解除",) and awards.tokens("本委") == () == awards.tokens("甲")


def test_runs_are_counted_over_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["甲乙，甲乙", None, "", "甲乙 丙"])], names=["text"])
    assert [b.to_pydict() for b in awards.count_tokens([batch])] == [{"token": ["甲乙"], "n": [3]}]


@pytest.mark.parametrize(
    "text,want",
    [
        ("申请人提交银行流水。", [("工资支付/银行流水", "employee", "申请人提交银行流水", 0.9)]),
        ("被申请人未提交银行流水，另有工资表在案。", [("工资支付/银行流水", "unknown", "被申请人未提交银行流水", 0.7)]),
        ("仅有薪资明细。", [("工资支付/银行流水", "unknown", "银行流水", 0.5)]),
        ("本院依法调取社保。", [("社保/工伤记录", "court", "本院依法调取社保", 0.9)]),
        ("", []),
    ],
)
def test_who_handed_it_in(text, want):
    assert awards.evidence(text) == want
