"""References to claims by number, and the ladder of reasons why an outcome isn't known, on cases with known answers."""

import pytest
from pyspark.sql import functions as F

from verdigris.functions import diagnoses as dg
from verdigris.functions.references import ordinal, resolved
from verdigris.operators import judgments

IDS = ["claim-1", "claim-2", "claim-3", "claim-4"]
#: Clause, claims dealt with before, status, reason, candidates: claims, treatment, action, reasoning.
CASES = [
    ("上述两项请求中，第一项缺乏依据，第二项予以支持", [], "resolved", "deterministic_ordinal_match", [(["claim-1"], "rejected", None, None), (["claim-2"], "accepted", None, None)]),
    ("对于前述三项请求，本院认为第一、三项有事实依据，第二项不予支持", [], "resolved", None, [(["claim-1", "claim-3"], "accepted", None, "multi_claim_reference"), (["claim-2"], "rejected", None, None)]),
    ("前两项请求予以支持", [], "resolved", None, [(["claim-1", "claim-2"], "accepted", None, "multi_claim_reference")]),
    ("第2项请求不能成立", [], "resolved", None, [(["claim-2"], "rejected", None, "ordinal_reference")]),
    ("第十项请求予以支持", [], "unresolved", "ordinal_out_of_range", []),
    ("第五项请求予以支持", [], "unresolved", "ordinal_out_of_range", []),
    ("关于加班工资问题，本院认为证据不足。故该项请求不予支持", [], "unresolved", "non_deterministic_anaphora", []),
    ("前述请求没有事实依据", [], "unresolved", None, []),
    ("该项请求，本院不予支持", [], "unresolved", None, []),
    ("驳回其余诉讼请求", ["claim-1", "claim-2"], "resolved", "remaining_claims_by_elimination", [(["claim-3", "claim-4"], "rejected", "reject", "remaining_claims")]),
    ("驳回其余诉讼请求", [], "unresolved", "remaining_claims_without_prior_mapping", []),
    ("驳回其余诉讼请求", IDS, "unresolved", "remaining_claims_without_prior_mapping", []),
    ("维持一审判决第一项；撤销第二项", [], "resolved", None, [(["claim-1"], "unclear", "maintain", "appeal_mapping"), (["claim-2"], "unclear", "revoke", "appeal_mapping")]),
    ("对上述请求，本院部分予以支持", [], "unresolved", None, []),
    ("第一、五项请求予以支持", [], "unresolved", "ordinal_out_of_range", []),
    ("前十二项请求予以支持", [], "unresolved", "ordinal_out_of_range", []),
    ("", [], "unresolved", "non_deterministic_anaphora", []),
]


def test_references(spark):
    df = spark.createDataFrame([(i, c[0], IDS, c[1]) for i, c in enumerate(CASES)], "i int, s string, ids array<string>, handled array<string>")
    got = {r["i"]: r["r"] for r in df.select("i", resolved(F.col("s"), F.col("ids"), F.col("handled")).alias("r")).collect()}
    for i, (source, _, status, reason, want) in enumerate(CASES):
        r = got[i]
        assert r["status"] == status and reason in (None, r["reason"]), source
        assert [list(x["claim_ids"]) for x in r["candidates"]] == [w[0] for w in want], source
        for x, w in zip(r["candidates"], want, strict=True):
            assert all(v in (None, x[k]) for k, v in zip(("treatment", "action", "reasoning"), w[1:], strict=True)), source


def test_numerals(spark):
    numerals = {"一": 1, "两": 2, "十": 10, "十一": 11, "二十": 20, "九十九": 99, "12": 12, "百": None, "一百": None, "二百十": None, "": None, "〇": 0}
    df = spark.createDataFrame([(k,) for k in numerals], "s string")
    assert {r["s"]: r["n"] for r in df.select("s", ordinal(F.col("s")).alias("n")).collect()} == numerals


def test_references_without_claims(spark):
    df = spark.createDataFrame([("第一项予以支持", None)], "s string, ids array<string>")
    r = df.select(resolved(F.col("s"), F.col("ids"), F.col("ids")).alias("r")).first()["r"]
    assert (r["status"], r["reason"], r["candidates"]) == ("unresolved", "ordinal_out_of_range", [])


def test_clauses_of_a_judgment(spark):
    text = "原告：张某。被告：甲有限公司。原告请求加班工资、经济补偿金和代通知金。判决如下：上述请求中，第一、二项有事实依据；第三项不予支持；驳回其余诉讼请求；第九项另案处理。"
    rows = judgments.resolve_references(judgments.read(spark.createDataFrame([("a", text)], "case_id string, text string"))).orderBy("pos").collect()
    # claims are numbered in the order of the rules: 经济补偿金, 代通知金, 加班工资
    assert [(r["reason"], [list(x["claim_ids"]) for x in r["candidates"]]) for r in rows] == [
        ("deterministic_ordinal_match", [["claim_1", "claim_2"]]), ("deterministic_ordinal_match", [["claim_3"]]), ("remaining_claims_without_prior_mapping", []), ("ordinal_out_of_range", []),
    ]


KNOWN = ("张某", "甲有限公司", "employee", 1.0, [("party_employee", "张某", "employee", ["plaintiff"]), ("party_employer", "甲有限公司", "employer", ["defendant"])])
UNCLEAR = ("unclear", "unclear", "unclear")


def claim(**more):
    base = {"id": "claim_1", "name": "加班工资", "type": "overtime_pay", "claimant_role": "employee", "claimant_party": None, "basis": "original_claim", "outcome": "unclear", "source": "原告请求支付加班工资。", "asked": None, "awarded": None, "orders": []}
    return tuple((base | more).values())


#: Decision, claims, orders (pos, source, action, target, type, awarded), the reason that must be among those given, and its suggestion.
LADDER = [
    ("支付工资1000元。", [claim(orders=[0])], [(0, "支付工资1000元。", "pay", "unknown", None, None)], "payment_beneficiary_unclear", "manual_review"),
    ("驳回诉讼请求。", [claim(orders=[0])], [(0, "驳回诉讼请求。", "reject", "unknown", None, None)], "rejection_owner_unclear", "manual_review"),
    ("驳回上诉，维持原判。", [claim(id="appeal_1", type="procedural_appeal", name="上诉请求", basis="appeal_request")], [], "appeal_inheritance_unclear", "rule_improvement"),
    ("判决如下：本案另行处理。", [claim(type="general_labor_claim", name="劳动争议综合请求 (其他)")], [], "unsupported_claim_type", "rule_improvement"),
    ("判决如下：本案另行处理。", [claim(source="原告请求加班工资及经济补偿金。"), claim(id="claim_2", source="原告请求经济补偿金。")], [], "ambiguous_multiple_claims", "rule_improvement"),
    ("判决如下：本案另行处理。", [claim(claimant_role="unknown")], [], "missing_claim_owner", "manual_review"),
    ("", [claim(source="")], [], "source_text_missing", "manual_review"),
    ("", [claim()], [], "missing_disposition_text", "manual_review"),
    ("支付加班工资1000元", [claim(outcome="supported", asked=5000.0, awarded=1000.0, orders=[0])], [(0, "支付加班工资1000元", "pay", "unknown", "overtime_pay", 1000.0)], "amount_conflict", "manual_review"),
]


def test_ladder_of_reasons(spark):
    party = "array<struct<id:string,name:string,labor_role:string,roles:array<string>>>"
    schema = (
        f"i int, decision string, known struct<employee:string,employer:string,applicant_role:string,confidence:double,parties:{party}>, claims array<struct<id:string,name:string,type:string,claimant_role:string,claimant_party:string,basis:string,outcome:string,source:string,asked:double,awarded:double,orders:array<int>>>, "
        "orders array<struct<pos:int,source:string,action:string,target:string,type:string,awarded:double>>, outcomes struct<employee:string,employer:string,applicant:string>"
    )
    df = spark.createDataFrame([(i, d, KNOWN, cs, os, UNCLEAR) for i, (d, cs, os, _, _) in enumerate(LADDER)], schema)
    got = {r["i"]: r["x"] for r in df.select("i", dg.diagnoses(F.col("decision"), F.col("claims"), F.col("orders"), F.col("known"), F.col("outcomes")).alias("x")).collect()}
    for i, (_, _, _, reason, suggestion) in enumerate(LADDER):
        assert (reason, suggestion) in {(x["reason"], x["suggestion"]) for x in got[i] if x["target"] == "claim"}, reason
        assert {x["target"] for x in got[i]} >= {"employee", "employer", "applicant"}


TEXTS = {
    "none": "原告：张某。被告：甲有限公司。原告请求支付加班工资。判决如下：本案另行处理。",
    "two_firms": "原告：甲有限公司。被告：乙有限公司。原告请求支付加班工资。判决如下：本案另行处理。",
    "nobody": "判决如下：本案另行处理。",
    "clear": "原告：张某。被告：甲有限公司。原告请求支付加班工资。判决如下：被告支付原告加班工资10000元。",
    "maintained": "上诉人：甲有限公司。被上诉人：劳动者乙。上诉人请求撤销原判。原审判决如下：确认双方劳动合同关系已经解除；甲有限公司支付劳动者乙经济补偿金69000元。二审判决如下：驳回上诉，维持原判。",
    "partial": "原告：劳动者丁。被告：甲有限公司。原告请求确认劳动关系解除、停工工资7798元及未签订书面劳动合同二倍工资差额50000元。判决如下：确认双方劳动关系于2022年4月29日解除；被告支付原告停工工资7798元；被告支付原告未签订书面劳动合同二倍工资差额33040元；驳回原告其他诉讼请求。",
}


def test_reasons_of_whole_texts(spark):
    df = judgments.read(spark.createDataFrame(list(TEXTS.items()), "case_id string, text string"))
    got = {r["case_id"]: r for r in df.select("case_id", "diagnostics", "outcomes").collect()}
    reasons = {k: {(x["target"], x["reason"]) for x in r["diagnostics"]} for k, r in got.items()}
    assert ("claim", "disposition_not_matched") in reasons["none"]
    assert ("employee", "missing_labor_role") in reasons["two_firms"]
    assert ("applicant", "missing_party_roles") in reasons["nobody"]
    assert reasons["clear"] == reasons["maintained"] == reasons["partial"] == set()
    assert (got["clear"]["outcomes"]["employee"], got["maintained"]["outcomes"]["employee"], got["partial"]["outcomes"]["employee"]) == ("supported", "supported", "partially_supported")


@pytest.mark.parametrize("statuses,want", [([], "unclear"), (["supported", "unclear"], "supported"), (["supported", "not_supported"], "partially_supported"), (["not_supported"], "not_supported"), (["partially_supported", "supported"], "partially_supported")])
def test_merged(spark, statuses, want):
    df = spark.createDataFrame([(statuses,)], "s array<string>")
    assert df.select(dg.merged(F.col("s"))).first()[0] == want
