"""Rule tables of court judgments on labour disputes.

Fixed values: names, key words and patterns that results depend on.
"""

from __future__ import annotations

from typing import NamedTuple

#: White space as it is met in Chinese texts.
BLANKS = " \n\r\t 　"
_S = "[\\s 　]"


class ClaimRule(NamedTuple):
    """A claim's name and type, the words for it, words that must stand near one of them, and whether a mention in the disposition alone isn't enough."""

    name: str
    type: str
    words: tuple[str, ...]
    context: tuple[str, ...] = ()
    from_request: bool = False


# The claims in the order in which they are looked for.
CLAIM_RULES = [
    ClaimRule("违法解除劳动合同赔偿金", "unlawful_termination_compensation", ("违法解除劳动合同赔偿金", "违法辞退赔偿金", "违法解除赔偿金", "解除劳动合同赔偿金")),
    ClaimRule("未依法缴纳社会保险经济补偿金", "social_insurance_compensation", ("未依法缴纳社会保险经济补偿金", "社会保险补偿", "社保经济补偿")),
    ClaimRule("补缴社会保险费", "social_insurance_contribution", ("补缴社会保险费", "补缴社会保险", "补缴社保", "补缴2021年4、5月社会保险费")),
    ClaimRule("解除劳动合同经济补偿金", "economic_compensation", ("解除劳动合同经济补偿金", "经济补偿金", "经济补偿", "解除经济补偿")),
    ClaimRule("代通知金", "notice_pay", ("代通知金", "一个月工资代通知金", "未提前三十日通知代通知金")),
    ClaimRule("加班工资", "overtime_pay", ("加班工资", "加班费", "延时加班工资", "休息日加班工资", "法定节假日加班工资")),
    ClaimRule("未休年休假工资", "annual_leave_pay", ("未休年休假工资", "年休假工资", "未休年假工资")),
    ClaimRule("未签书面劳动合同二倍工资差额", "double_wage_difference", ("未签书面劳动合同二倍工资", "未签订书面劳动合同二倍工资差额", "二倍工资差额", "双倍工资差额", "双倍工资", "二倍工资")),
    ClaimRule("一次性伤残补助金", "disability_allowance", ("一次性伤残补助金", "伤残补助金"), ("工伤", "伤残", "伤残等级", "劳动能力鉴定", "工伤保险待遇"), True),
    ClaimRule("一次性工伤医疗补助金", "work_injury_medical_subsidy", ("一次性工伤医疗补助金", "工伤医疗补助金"), ("工伤", "伤残", "伤残等级", "劳动能力鉴定", "工伤保险待遇"), True),
    ClaimRule("一次性伤残就业补助金", "disability_employment_subsidy", ("一次性伤残就业补助金", "伤残就业补助金"), ("工伤", "伤残", "伤残等级", "劳动能力鉴定", "工伤保险待遇"), True),
    ClaimRule("劳动能力鉴定费", "labor_capacity_assessment_fee", ("劳动能力鉴定费", "鉴定费"), ("工伤", "劳动能力鉴定", "伤残等级", "工伤保险待遇"), True),
    ClaimRule("工伤医疗费", "work_injury_medical_expense", ("工伤医疗费", "工伤医疗费用", "医疗费"), ("工伤", "工伤待遇", "工伤保险待遇", "伤残", "劳动能力鉴定"), True),
    ClaimRule("停工留薪期待遇", "work_injury_allowance", ("停工留薪期待遇", "停工留薪期工资", "停工留薪期"), ("工伤", "停工留薪"), True),
    ClaimRule("护理费", "nursing_fee", ("护理费",), ("工伤", "伤残", "住院", "工伤保险待遇", "劳动能力鉴定"), True),
    ClaimRule("住院伙食补助费", "hospital_food_subsidy", ("住院伙食补助费", "伙食补助费"), ("工伤", "住院", "工伤保险待遇"), True),
    ClaimRule("交通食宿费", "transportation_accommodation_fee", ("交通食宿费", "交通费", "食宿费"), ("工伤", "工伤治疗", "住院", "工伤保险待遇", "劳动能力鉴定"), True),
    ClaimRule("拖欠/未付劳动报酬", "unpaid_remuneration", ("工资差额", "支付工资", "拖欠工资", "克扣工资", "补发工资", "劳动报酬", "业务提成", "业务费用", "停工工资", "停业工资", "疫情期间停业工资", "被查封期间工资", "封控工资")),
    ClaimRule("劳动关系解除确认", "employment_termination_confirmation", ("确认解除劳动合同", "确认劳动关系解除", "确认双方劳动关系已经解除", "确认双方劳动合同关系已经解除", "确认双方劳动关系于", "确认双方劳动合同关系于", "劳动合同关系已经解除", "解除劳动关系")),
]
#: An order that confirms an end names that claim in this form too.
CONFIRMATION, CONFIRMS = "employment_termination_confirmation", "确认[^。；，,]*(?:劳动关系|劳动合同关系)(?:于[^。；，,]*)?(?:已经|已)?解除"
GENERAL_CLAIM, APPEAL_CLAIM = "劳动争议综合请求 (报酬/补偿)", "上诉请求（撤销原判）"
#: Claims of money; the types that other sources use are among them.
MONETARY = (
    "wage_payment", "labor_remuneration", "unpaid_remuneration", "overtime_pay", "overtime_wage", "double_wage_difference", "double_wage_without_written_contract", "economic_compensation",
    "unlawful_termination_compensation", "annual_leave_pay", "annual_leave_wage", "notice_pay", "bonus", "commission", "performance_wage", "performance_bonus",
)

# Parties.
PARTY = f"(?:^|[。；;\\n\\r）)号书]){_S}*(反诉原告|反诉被告|反诉人|原审原告|原审被告|被上诉人|上诉人|被申请人|申请人|被申诉人|申诉人|原告|被告|第三人)(?:[（(［\\[].{{0,60}}?[）)］\\]])?[：:\\s 　]+([^，,。；;\\n\\r]+)"
IDENTITY_ENDS = "本院认为|经审理查明|诉称|辩称|庭审|质证|审理终结|认为|主张|答辩"
IDENTITY_LENGTH = 12000
FIRST_SIDE = ("原审原告", "上诉人", "申请人", "申诉人", "原告")
SECOND_SIDE = ("原审被告", "被上诉人", "被申请人", "被申诉人", "被告")
PROCEDURAL_ROLES = {
    "原告": "plaintiff", "被告": "defendant", "上诉人": "appellant", "被上诉人": "appellee", "申请人": "applicant", "被申请人": "respondent",
    "反诉原告": "counterclaimPlaintiff", "反诉人": "counterclaimPlaintiff", "反诉被告": "counterclaimDefendant", "第三人": "third_party",
}
FIRM = "公司|厂|企业|中心|集团|行|店|事务所|医院|学校|院|部|局|委|队|商行|工作室|分公司"
ORGANISATION = "公司|有限责任公司|厂|企业|中心|集团|银行|医院|学校|事务所|研究院|仲裁委员会|人民法院|工会|委员会|局|院|部|店|商行|工作室|经营部|分公司|劳务派遣"
PERSON = "^[一-龥]{2,6}$"
NO_PERSON = "^(?:劳动者|员工|职工|个人|自然人|为其成员|系.+|依法.+|应当.+|可以.+|不得.+)$"
STATEMENT = "是|认为|根据|就是|吗|啊|对呀|反正|工资是|奖金是|请求|支付|法院|判令|前提|确保|是否|因为|所以"
NO_NAME = "^(?:劳动者|员工|职工|个人|自然人|公司员工|双方|对方|本院|原告|被告|上诉人|被上诉人|答辩|意见|问题|情况|事情|事实|理由)$"
NO_NAME_END = "(?:对呀|对啊|是的|那就是|反正|啊)$"
TITLE = "^(.{2,30}?)(?:与|诉)(.{2,40}?)(?:劳动争议|劳务合同纠纷|追索劳动报酬)"
WORKER = f"(?:劳动者|员工|职工|被害人|伤者)[：:]{_S}*([一-龥]{{2,5}})[，,。；;\\s 　]"
WORKER_IN_CONTEXT = f"(?:原告|上诉人|申请人|被告|被上诉人){_S}*([一-龥]{{2,4}}){_S}*(?:于|入职|主张|诉称|在[一-龥]+工作|系[一-龥]+员工)"
FIRM_IN_CONTEXT = "([一-龥]{2,20}(?:有限责任公司|有限公司|厂|企业|经营部))"
COUNTERCLAIM = "(?:被告|被申请人)[^。；\\n]*(?:提出反诉|反诉请求|提起反诉)"

# Sections.  What the first group of a pattern takes is the section.
_MORE = f"[，：:\\s 　]+"
APPLICANT_SECTION = (
    f"((?:(?:原告|申请人|上诉人)(?:向[^：:。]{{0,30}})?(?:提出)?(?:诉讼请求|上诉请求|请求|诉称|称|上诉称|主张)|申请仲裁称|原告向本院提出诉讼请求){_MORE}[\\s\\S]*?)"
    "(?:(?:被告|被上诉人|被申请人)(?:辩称|答辩|称|主张)|经审理查明|本院经审理查明|查明|本案相关情况|仲裁庭查明|法院查明|本院认为|判决如下|裁决如下)"
)
RESPONDENT_SECTION = (
    f"(?:(?:被告|被上诉人|被申请人|公司|用人单位)(?:辩称|答辩称|答辩|称|主张)){_MORE}([\\s\\S]*?)"
    "(?:经审理查明|本院经审理查明|查明|本案相关情况|仲裁庭查明|法院查明|本院认为|仲裁庭认为|本院经审理认为|本庭认为)"
)
FACTS_SECTION = (
    f"(?:经审理查明|本院经审理查明|查明|本案相关情况|仲裁庭查明|法院查明){_MORE}([\\s\\S]*?)"
    "(?:本院认为|法院认为|本院经审理认为|本院认为：|经审理，本院认为|本院综合认为|综上|本院评析|裁判理由|仲裁庭认为|本庭认为|依照《)"
)
REASONING_SECTION = (
    f"(?:本院认为|法院认为|本院经审理认为|本院认为：|经审理，本院认为|本院综合认为|本院评析|裁判理由|仲裁庭认为|本庭认为){_MORE}([\\s\\S]*?)"
    "(?:判决如下|裁决如下|裁定如下|据此|综上，依照|综上所述，依照)"
)
REASONING_ELSE = f"(?:综上){_MORE}([\\s\\S]*?)(?:判决如下|裁决如下|裁定如下)"
DECISION_SECTION = (
    f"(?:综上[，,、\\s 　]*(?:本院)?判决如下|本院判决如下|判决如下|判决|裁决如下|裁定如下)[：:\\s 　]+([\\s\\S]*?)"
    f"(?:如不服|审{_S}*判{_S}*长|审{_S}*判{_S}*员|仲{_S}*裁{_S}*员|书{_S}*记{_S}*员|\\z)"
)
DISPOSITION = "裁判主文|裁判结果|判决如下|裁决如下|裁定如下"
CLIP = 1500

# Orders of a decision.
SENTENCES, CLAUSES = "[。；;\\n\\r]+", "[。；;，,\\n\\r]+"
ACTIONS = [
    ("reject", "驳回|不予支持|无需支付|不予处理|不属于(?:人民法院|民事诉讼|劳动争议)"),
    ("support", "予以支持|支持|确认[^。；，,]*(?:劳动关系|劳动合同关系)?(?:已经|已)?解除"),
    ("pay", "支付|补缴|补发"),
    ("maintain", "维持(?:原判|原裁决)"),
    ("revoke", "撤销"),
]
AGAINST_FIRM = "驳回(?:公司|用人单位|企业)[^。；，,]*(?:诉讼请求|请求)"
TARGETS = [("appellant", "驳回上诉"), ("defendant", "被告[^。；，,]*(?:反诉|请求)"), ("appellee", "被上诉人"), ("appellant", "上诉人|上诉请求"), ("plaintiff", "原告|申请人")]
PAYMENT = "支付|补发|补缴"
BENEFICIARY = ("appellee", "plaintiff", "defendant", "appellant")
NOT_CONTINUED = "上诉|维持原判|维持原裁决|原审|其他"
NOT_GENERIC = "上诉|维持原判|维持原裁决|原审"
AMOUNT = "(?:人民币\\s*)?([0-9][0-9,]*(?:\\.\\d+)?)\\s*元"
ASKED = "(?:请求|主张|要求)[^。；;]*?" + AMOUNT
AWARDED = "(?:支付|支持|补缴|补发|判付)[^。；;]*?" + AMOUNT
#: Characters after a claim's words in which its amount is looked for, and about them in which its context is.
NEAR, AROUND = 48, 100

# Where a claim's request is taken from.
REASONING_MARK = "本院认为|法院认为|经审理查明|本院查明|本院认定|争议焦点|裁判理由|裁判主文|裁判结果|判决如下|裁决如下|本院不予支持|不予支持|不予采纳"
DEFENCE_MARK = (
    "辩称|答辩称|答辩|抗辩|没有主张|未主张|不主张|认为对方请求无依据|请求无依据|请求不成立|关于(?:原告|被告|对方)[^。；;\\n]{0,80}(?:主张|请求)"
    "|关于[^。；;\\n]{0,80}(?:主张|请求)(?:[^。；;\\n]{0,30}(?:不予|无依据|不成立|意见|辩称|答辩))|对(?:原告|被告|对方)?[^。；;\\n]{0,50}(?:诉讼请求|请求)(?:[^。；;\\n]{0,30}(?:发表意见|辩称|答辩))"
    "|(?:仲裁|本院|法院)(?:认定|裁决|判决|裁定|结论)|本院不予支持|不予支持|不予采纳"
)
REQUEST_MARK = (
    "诉讼请求|上诉请求|仲裁请求|向[^。；;\\n]{0,40}提出(?:诉讼|上诉|仲裁)?请求|请求(?:判令|裁决|支付|确认|撤销|解除|补缴|赔偿|给付)|要求(?:支付|确认|撤销|解除|补缴|赔偿|给付)"
    "|主张(?:支付|确认|撤销|解除|补缴|赔偿|给付)|(?:请求\\s*)?判令(?:[^。；;\\n]{0,30}(?:支付|确认|撤销|解除|补缴|赔偿|给付))"
)
REQUEST_BEFORE = "(?:诉讼请求|上诉请求|仲裁请求|反诉请求|请求|主张|要求)[^。；;\\n]{0,40}$"
ARBITRATION_MARK, APPEAL_MARK = "仲裁请求|申请仲裁|仲裁时", "上诉请求|上诉人|撤销原判|改判"
ARBITRATION_SECTION, APPEAL_SECTION = "仲裁请求|申请仲裁", "上诉请求|上诉人"
APPEAL_STATED = "上诉人[^。；;\\n\\r]{0,60}(?:主张|认为|请求|要求|改判|撤销原判)"
APPEAL_ASKED = "上诉请求|上诉人[^。；;\\n\\r]{0,60}(?:请求|主张|要求|改判|撤销原判)"
APPEAL_NOT_STATED = "本院认为|原审判决认定|缺乏理据|不予支持"
COUNTER_MARK = f"反诉原告|反诉人|反诉请求|(?:^|[。；;\\n\\r]){_S}*(?:被告|被申请人|被上诉人)[^。；;\\n\\r]*(?:反诉|请求|主张)"
APPEAL_BASIS = "上诉人|上诉请求|撤销原判"
PROCEDURAL_MARK = "上诉人|上诉请求|撤销原判|申请人|反诉"

# References to claims by their number.
DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
NUMBERED = "第([一二两三四五六七八九十百〇零\\d]+(?:[、，,及和与][一二两三四五六七八九十百〇零\\d]+)*)项"
NUMBER_JOINTS = "[、，,及和与]"
LEADING = "前([一二两三四五六七八九十\\d]+)项"
REMAINING = "其余(?:诉讼|上诉|仲裁)?请求"
EARLIER_JUDGMENT = "一审判决|原判"
TREATMENTS = [
    ("partially_accepted", "部分(?:予以)?支持|部分有依据"),
    ("rejected", "不予支持|不支持|驳回|缺乏依据|无事实(?:和|及)?法律依据|不能成立"),
    ("not_addressed", "未处理|不予审理|另案处理"),
    ("accepted", "予以支持|应予支持|有(?:事实|法律|事实和法律)?依据|成立"),
]
REFERENCE_ACTIONS = [("maintain", "维持"), ("revoke", "撤销"), ("reject", "不予支持|不支持|驳回|缺乏依据|不能成立"), ("support", "予以支持|应予支持|有(?:事实|法律|事实和法律)?依据|成立")]
