"""Parties, orders and claims of court judgments on worded cases with known answers."""

import pytest
from pyspark.sql import functions as F

from verdigris.operators import judgments

INJURY = (
    "工伤保险待遇纠纷。原告：劳动者甲。被告：某教育培训中心。关于一次性伤残补助金，因为原告在交通事故中没有主张。原告针对被告的诉讼请求辩称，仲裁关于一次性伤残补助金和劳动能力鉴定费的认定不应支持。"
    "原告向本院提出诉讼请求，判令被告支付停工留薪期工资10000元。判决如下：驳回其他诉讼请求。"
)
TWO_APPEALS = (
    "广东粤建工程项目管理有限公司云浮分公司、罗恒平劳动合同纠纷二审。上诉人：广东粤建工程项目管理有限公司云浮分公司。上诉人：罗恒平。被上诉人：广东粤建工程项目管理有限公司云浮分公司。罗恒平在仲裁时提出的请求是加班工资5250元。"
    "上诉人罗恒平向本院提起上诉，请求补发加班工资5250元。上诉人广东粤建工程项目管理有限公司云浮分公司向本院提起上诉，请求改判无需支付加班工资。判决如下：驳回上诉，维持原判。"
)
HEADING = (
    "合成民事判决书（2024）示范终0001号上诉人（原审原告）：某精密科技公司，被上诉人（原审被告）：劳动者乙。某精密科技公司向原审法院提出诉讼请求：无需向劳动者乙支付经济补偿金52584元。"
    "原审法院判决如下：确认某精密科技公司与劳动者乙的劳动合同关系已经解除；限某精密科技公司向劳动者乙支付经济补偿金52584元。二审判决如下：驳回上诉，维持原判。"
)
MAINTAINED = "上诉人：甲有限公司。被上诉人：{0}。上诉人请求撤销原判。原审判决如下：确认双方劳动合同关系已经解除；甲有限公司支付{0}经济补偿金{1}元。二审判决如下：驳回上诉，维持原判。"
WORKER = "原告：张某。被告：甲有限公司。"
FIRM = "原告：甲有限公司。被告：张某。"

TEXTS = {
    "litigation": ("原告：张某。被告：甲公司。原告请求支付加班工资10000元。判决如下：驳回原告加班工资请求。", None),
    "appeal": ("上诉人：甲公司。被上诉人：张某。上诉人请求撤销原判。二审判决如下：驳回上诉，维持原判。", None),
    "arbitration": ("申请人：张某。被申请人：甲公司。申请仲裁请求支付工资10000元。裁决如下：被申请人支付工资10000元。", None),
    "structured": ("原告：张某。被告：甲公司。本院认为，张某的加班工资请求证据不足。判决如下：驳回原告请求。", "原告向法院提出诉讼请求：请求支付加班工资10000元。"),
    "analysis": ("原告：林某。被告：甲公司。法院分析：本院认为，劳动者的年休假工资请求证据不足。", None),
    "main_text": ("原告：林某。被告：甲公司。裁判主文：驳回原告关于年休假工资的诉讼请求。", None),
    "reasoning_1": ("原告：劳动者甲。被告：某公司。本院认为，林某确认各年度休假情况，但未休未休年休假工资请求本院不予支持。判决如下：驳回原告其他诉讼请求。", None),
    "reasoning_2": ("原告：劳动者甲。被告：某公司。关于争议焦点一，未休未休年休假工资请求本院认为该项主张不予采纳。判决如下：驳回原告其他诉讼请求。", None),
    "label": ("原告：劳动者甲。被告：某公司。本院认为，未休年休假工资请求不予支持。判决如下：驳回原告其他诉讼请求。", None),
    "injury": (INJURY, None),
    "statement": ("原告：张某。被告：甲公司。被告答辩称，但被告反诉请求支付加班工资1000元。本院认为，反诉请求依法审理。判决如下：驳回原告其他诉讼请求。", None),
    "counterclaim": ("原告：甲公司。被告：劳动者乙。被告反诉请求支付经济补偿金144420元。判决如下：反诉被告支付反诉原告经济补偿金144420元。", None),
    "underlying": ("上诉人：甲公司。被上诉人：张某。仲裁请求：请求支付加班工资5250元。二审判决如下：驳回上诉，维持原判。", None),
    "two_appeals": (TWO_APPEALS, None),
    "no_source": ("上诉人：甲公司。被上诉人：张某。张某请求支付双倍工资84000元。上诉人甲公司认为原判认定双倍工资错误。二审判决如下：驳回上诉，维持原判。", None),
    "firm_claims": (FIRM + "原告请求确认无需支付经济补偿金。判决如下：支持原告诉讼请求。", None),
    "both_claim": (WORKER + "原告请求被告支付加班工资30000元。被告甲有限公司提出反诉，请求确认无需支付经济补偿金10000元。判决如下：被告支付原告加班工资30000元；驳回被告反诉请求。", None),
    "procedural": ("上诉人：甲有限公司。被上诉人：张某。上诉人请求撤销原判。判决如下：驳回上诉请求。", None),
    "three": (WORKER + "原告请求违法解除劳动合同赔偿金20000元、加班工资30000元、未休年休假工资3000元。判决如下：支付违法解除劳动合同赔偿金20000元；驳回加班工资请求；未休年休假工资请求3000元，支持1000元。", None),
    "references": (WORKER + "原告请求加班工资和经济补偿金。判决如下：上述两项请求中，第一项予以支持，第二项驳回。", None),
    "confirmed": (WORKER + "原告请求确认劳动关系。判决如下：确认双方劳动关系已经解除。", None),
    "contract": (WORKER + "原告请求确认劳动合同关系。判决如下：确认双方劳动合同关系已经解除。", None),
    "firm_rejected": (FIRM + "原告请求确认无需支付经济补偿金，被告请求支付经济补偿金。判决如下：驳回公司的全部诉讼请求；支付张某经济补偿金52584元。", None),
    "maintained": (MAINTAINED.format("张某", 52584), None),
    "maintained_2": (MAINTAINED.format("劳动者丙", 69000), None),
    "wages": ("原告：劳动者甲。被告：甲有限公司。原告请求支付劳动报酬。判决如下：被告支付原告劳动报酬57060元。", None),
    "double": ("原告：劳动者丁。被告：甲有限公司。原告请求支付未签订书面劳动合同二倍工资差额50000元。判决如下：被告支付原告未签订书面劳动合同二倍工资差额33040元。", None),
    "others": ("原告：劳动者丁。被告：甲有限公司。原告请求支付停工工资、二倍工资差额及其他请求。判决如下：被告支付原告停工工资7798元；驳回原告其他诉讼请求。", None),
    "heading": (HEADING, None),
    "wage_heading": ("合成民事判决书（2024）示范初0001号原告：劳动者甲，男。被告：某公司。原告因被告拖欠劳动报酬未付，向法院提起诉讼，请求判令：被告向原告支付业务提成费57060元。本院认为被告应向原告支付业务费57060元。判决如下：被告向原告支付业务费用57060元。", None),
    "commission": ("原告：劳动者甲。被告：某公司。原告请求支付业务提成/劳动报酬57060元。判决如下：被告支付原告业务提成/劳动报酬57060元。", None),
    "mixed": ("原告：劳动者丁。被告：甲有限公司。原告请求确认劳动关系解除、停工工资7798元及未签订书面劳动合同二倍工资差额50000元。判决如下：确认双方劳动关系于2022年4月29日解除；被告支付原告停工工资7798元；被告支付原告未签订书面劳动合同二倍工资差额33040元；驳回原告其他诉讼请求。", None),
    "empty": ("", None),
    "null": (None, None),
}

#: Of a case, the claim of a type: what its fields must be.
CLAIMS = [
    ("litigation", "overtime_pay", {"source_kind": "litigation_request", "source_field": "fbqw", "source": "原告请求支付加班工资10000元"}),
    ("arbitration", "unpaid_remuneration", {"source_kind": "arbitration_request", "source": "申请仲裁请求支付工资10000元"}),
    ("structured", "overtime_pay", {"source_kind": "litigation_request", "source_field": "ssjl", "source": "原告向法院提出诉讼请求：请求支付加班工资10000元"}),
    ("analysis", "annual_leave_pay", {"source_kind": "unknown", "source": ""}),
    ("reasoning_1", "annual_leave_pay", {"source_kind": "unknown", "source": ""}),
    ("reasoning_2", "annual_leave_pay", {"source_kind": "unknown", "source": ""}),
    ("label", "annual_leave_pay", {"name": "未休年休假工资", "source": ""}),
    ("injury", "disability_allowance", {"source": "", "source_kind": "unknown"}),
    ("injury", "labor_capacity_assessment_fee", {"source": "", "source_kind": "unknown"}),
    ("injury", "work_injury_allowance", {"source_kind": "litigation_request", "source": "原告向本院提出诉讼请求，判令被告支付停工留薪期工资10000元"}),
    ("statement", "overtime_pay", {"source_kind": "party_statement", "source": "但被告反诉请求支付加班工资1000元"}),
    ("counterclaim", "economic_compensation", {"claimant_role": "employee", "basis": "counterclaim", "source_kind": "litigation_request"}),
    ("underlying", "overtime_pay", {"claimant_role": "employee", "source_kind": "arbitration_request", "basis": "original_claim", "claimant_party": "party_2"}),
    ("firm_claims", "economic_compensation", {"claimant_role": "employer", "basis": "original_claim"}),
    ("both_claim", "overtime_pay", {"claimant_role": "employee", "basis": "original_claim", "asked": 30000.0, "claimant_party": "party_1"}),
    ("both_claim", "economic_compensation", {"claimant_role": "employer", "basis": "counterclaim", "asked": 10000.0, "claimant_party": "party_2"}),
    ("procedural", "procedural_appeal", {"claimant_role": "employer", "basis": "appeal_request", "outcome": "not_supported"}),
    ("three", "unlawful_termination_compensation", {"asked": 20000.0, "awarded": 20000.0, "outcome": "supported"}),
    ("three", "overtime_pay", {"asked": 30000.0, "awarded": 0.0, "outcome": "not_supported"}),
    ("three", "annual_leave_pay", {"asked": 3000.0, "awarded": 1000.0, "outcome": "partially_supported"}),
    ("confirmed", "employment_termination_confirmation", {"name": "劳动关系解除确认", "outcome": "supported"}),
    ("contract", "employment_termination_confirmation", {"name": "劳动关系解除确认", "outcome": "supported"}),
    ("firm_rejected", "economic_compensation", {"outcome": "supported"}),
    ("maintained", "employment_termination_confirmation", {"outcome": "supported"}),
    ("maintained", "economic_compensation", {"outcome": "supported", "awarded": 52584.0}),
    ("maintained", "procedural_appeal", {"name": "上诉请求（撤销原判）", "claimant_role": "employer", "outcome": "not_supported"}),
    ("maintained_2", "economic_compensation", {"outcome": "supported", "awarded": 69000.0}),
    ("maintained_2", "procedural_appeal", {"claimant_role": "employer", "outcome": "not_supported"}),
    ("wages", "unpaid_remuneration", {"outcome": "supported", "awarded": 57060.0}),
    ("double", "double_wage_difference", {"outcome": "partially_supported", "asked": 50000.0, "awarded": 33040.0}),
    ("others", "unpaid_remuneration", {"outcome": "supported"}),
    ("heading", "employment_termination_confirmation", {"outcome": "supported"}),
    ("heading", "procedural_appeal", {"name": "上诉请求（撤销原判）", "claimant_role": "employer", "outcome": "not_supported"}),
    ("wage_heading", "unpaid_remuneration", {"claimant_role": "employee", "basis": "original_claim", "outcome": "supported"}),
    ("commission", "unpaid_remuneration", {"claimant_role": "employee", "outcome": "supported", "awarded": 57060.0}),
    ("mixed", "employment_termination_confirmation", {"outcome": "supported"}),
    ("mixed", "unpaid_remuneration", {"claimant_role": "employee", "outcome": "supported", "awarded": 7798.0}),
    ("mixed", "double_wage_difference", {"outcome": "partially_supported", "asked": 50000.0, "awarded": 33040.0}),
    ("null", "general_labor_claim", {"outcome": "unclear", "claimant_role": "unknown", "source": ""}),
]

#: Employee's and employer's outcome of a case.
OUTCOMES = {
    "three": ("partially_supported", "partially_supported"), "firm_rejected": ("supported", "not_supported"), "maintained": ("supported", "not_supported"), "maintained_2": ("supported", "not_supported"), "wage_heading": ("supported", None),
    "commission": ("supported", None), "mixed": ("partially_supported", None),
}

PARTIES = {
    "title": ("", "廖某与甲有限公司劳动争议二审民事判决书", "廖某", "甲有限公司", []),
    "nested": ("上诉人（原审被告）：广州曰之昇科技有限公司，住所地广州市。\n被上诉人（原审原告）：廖春群，女，住湖南省。\n劳动关系是指用人单位招用劳动者为其成员。", None, "廖春群", "广州曰之昇科技有限公司", [("广州曰之昇科技有限公司", "employer", {"appellant"}), ("廖春群", "employee", {"appellee"})]),
    "consolidated": ("上诉人［一案原告、另一案被告］:广州市雅莲酒店管理有限公司，住所地广州市。\n上诉人［一案被告、另一案原告］:张先甫，男，住湖北省。", None, "张先甫", "广州市雅莲酒店管理有限公司", None),
    "generic_1": ("原告：甲有限公司。被告：乙有限公司。劳动者为其成员，依法参加工会活动。", None, None, "甲有限公司", None),
    "generic_2": ("原告：甲有限公司。被告：乙有限公司。劳动者系依法享有劳动权利的主体。", None, None, "甲有限公司", None),
    "generic_3": ("原告：甲有限公司。被告：乙有限公司。劳动者依法享有取得劳动报酬的权利。", None, None, "甲有限公司", None),
    "generic_4": ("原告：甲有限公司。被告：乙有限公司。劳动者应当完成劳动任务。", None, None, "甲有限公司", None),
    "counter": ("原告：张某。被告：甲有限公司。被告甲有限公司提出反诉，请求确认无需支付经济补偿金。", None, "张某", "甲有限公司", [("张某", "employee", {"plaintiff"}), ("甲有限公司", "employer", {"defendant", "counterclaimant", "counterclaimPlaintiff"})]),
    "arbitration": ("申请人：张某。被申请人：甲有限公司。", None, "张某", "甲有限公司", [("张某", "employee", {"applicant"}), ("甲有限公司", "employer", {"respondent"})]),
    "third": ("原告：张某。被告：甲有限公司。第三人：乙劳务派遣有限公司。", None, "张某", "甲有限公司", [("张某", "employee", {"plaintiff"}), ("甲有限公司", "employer", {"defendant"}), ("乙劳务派遣有限公司", "other", {"third_party"})]),
    "head_only": ("某设计咨询公司与劳动者甲劳动合同纠纷一审民事判决书\n原告：某设计咨询公司\n被告：劳动者甲\n本院认为，被告：效益工资是根据公司的经济状况。\n被告：年终奖是年终的事情。", None, "劳动者甲", "某设计咨询公司", [("某设计咨询公司", "employer", {"plaintiff"}), ("劳动者甲", "employee", {"defendant"})]),
    "counter_named": ("上诉人（原审被告）：甲有限公司。被上诉人（原审原告）：张某。反诉原告：张某。反诉被告：甲有限公司。", None, "张某", "甲有限公司", [("甲有限公司", "employer", {"appellant", "counterclaimDefendant"}), ("张某", "employee", {"appellee", "counterclaimPlaintiff"})]),
    **{f"statement_{i}": (f"原告：某设计咨询公司\n被告：劳动者甲\n庭审记录\n{s}", None, "劳动者甲", "某设计咨询公司", [("某设计咨询公司", "employer", {"plaintiff"}), ("劳动者甲", "employee", {"defendant"})]) for i, s in enumerate(["被告：效益工资是根据公司的经济状况", "被告：年终奖是年终的事情", "被告：对呀", "被告：反正我认为作为奖金就是一个可浮动的", "被告：……浮动的前提下我这个月工资还能确保跟去年持平吗？", "被告：那就是啊"])},
}


@pytest.fixture(scope="module")
def read(spark):
    rows = [(k, text, None, request) for k, (text, request) in TEXTS.items()]
    df = spark.createDataFrame(rows, "case_id string, text string, title string, request string")
    return {r["case_id"]: r for r in judgments.read(df).select("case_id", "known", "claims", "orders", "references", "diagnostics", "outcomes").collect()}


@pytest.mark.parametrize("case,kind,want", CLAIMS)
def test_claims(read, case, kind, want):
    claim = next(c for c in read[case]["claims"] if c["type"] == kind)
    assert {k: claim[k] for k in want} == want


def test_numbers_and_places(read):
    for r in read.values():
        assert [c["id"] for c in r["claims"]] == [f"claim_{i + 1}" for i in range(len(r["claims"]))]
        places = {o["pos"]: o for o in r["orders"]}
        assert all(places[i]["type"] == c["type"] or c["type"] == "procedural_appeal" for c in r["claims"] for i in c["orders"])
    assert len(read["procedural"]["claims"]) == 1
    assert [c["orders"] for c in read["references"]["claims"]] == [[], []]


def test_disposition_alone_makes_no_source(read):
    for case in ("main_text", "analysis"):
        assert all("本院认为" not in c["source"] and "驳回原告" not in c["source"] for c in read[case]["claims"] if c["type"] == "annual_leave_pay")


def test_appeal_is_a_claim_of_its_own(read):
    claims = [c for c in read["two_appeals"]["claims"] if c["type"] == "overtime_pay"]
    employee = next(c for c in claims if c["claimant_role"] == "employee")
    firm = next(c for c in claims if c["claimant_role"] == "employer" and c["basis"] == "appeal_request")
    assert firm["source_kind"] == "appeal_request" and firm["source"] != employee["source"] and "无需支付加班工资" in firm["source"]
    claims = [c for c in read["no_source"]["claims"] if c["type"] == "double_wage_difference"]
    employee = next(c for c in claims if c["claimant_role"] == "employee")
    firm = next(c for c in claims if c["claimant_role"] == "employer")
    assert employee["source_kind"] == "litigation_request" and "张某请求支付双倍工资" in employee["source"]
    assert (firm["source"], firm["source_kind"], firm["basis"]) == ("", "appeal_request", "appeal_request")


def test_counterclaimant(read):
    party = next(p for p in read["counterclaim"]["known"]["parties"] if p["name"] == "劳动者乙")
    assert "counterclaimPlaintiff" in party["roles"]


@pytest.mark.parametrize("case", OUTCOMES)
def test_party_outcomes(read, case):
    employee, employer = OUTCOMES[case]
    got = read[case]["outcomes"]
    assert got["employee"] == employee and (employer is None or got["employer"] == employer)


def test_heading_has_known_outcomes(read):
    assert "unclear" not in (read["heading"]["outcomes"]["employee"], read["heading"]["outcomes"]["employer"])


def test_references_are_left_to_the_resolver(read):
    got = read["references"]["references"]
    assert [r["claim_ids"] for r in got] == [["claim_1"], ["claim_2"]]


@pytest.fixture(scope="module")
def known(spark):
    from verdigris.functions.parties import recognised

    df = spark.createDataFrame([(k, v[0], v[1]) for k, v in PARTIES.items()], "k string, text string, title string")
    return {r["k"]: r["p"] for r in df.select("k", recognised(F.col("text"), F.col("title")).alias("p")).collect()}


@pytest.mark.parametrize("case", PARTIES)
def test_parties(known, case):
    _, _, employee, employer, parties = PARTIES[case]
    got = known[case]
    assert (got["employee"], got["employer"]) == (employee, employer)
    if parties is not None:
        assert [(p["name"], p["labor_role"], set(p["roles"])) for p in got["parties"]] == parties
