"""Rule tables of labour-dispute texts.

Fixed values: names, patterns, key words and weights that results depend on.
"""

from __future__ import annotations

from typing import NamedTuple

from verdigris.functions.court_tables import CLAIM_RULES


class Rule(NamedTuple):
    """A label with the patterns that give it, those that give it in a wider text, and its weight."""

    name: str
    patterns: tuple[str, ...]
    weight: float = 0.9
    group: str = ""
    context: tuple[str, ...] = ()


DISPUTES = [
    Rule("解除", ("违法解除|解除劳动合同|通知解除|解除劳动关系|辞退|开除|解聘", "用人单位解除|劳动者解除|单方解除"), 0.9, "解除终止"),
    Rule("终止", ("终止劳动合同|合同到期终止|劳动合同期满|终止劳动关系",), 0.85, "解除终止"),
    Rule("经济补偿", ("经济补偿金?|解除经济补偿|补偿金[0-9]+元|支付经济补偿",), 0.9, "解除终止"),
    Rule("赔偿金", ("违法解除劳动合同赔偿金|双倍赔偿金|赔偿金[0-9]+元|赔偿金争议",), 0.95, "解除终止"),
    Rule("工资", ("拖欠工资|未付工资|克扣工资|补发工资|基本工资|绩效工资|工资差额", "提成工资|岗位工资|津贴|年终奖金?"), 0.85, "劳动报酬"),
    Rule("加班", ("加班工资|加班费|延长工作时间加班|休息日加班|法定节假日加班|延时加班",), 0.9, "劳动报酬"),
    Rule("年休假", ("带薪年休假|年休假工资|未休年休假|应休未休年休假",), 0.9, "劳动报酬"),
    Rule("竞业限制", ("竞业限制|竞业禁止|竞业限制补偿金|违约金|保密协议",), 0.95, "管理履约"),
    Rule("调岗", ("调岗|调整工作岗位|调岗降薪|调整职务|变更工作地点|岗位变动",), 0.9, "管理履约"),
    Rule("劳动关系", ("确认劳动关系|事实劳动关系|未订立书面劳动合同|双倍工资|未签合同",), 0.9, "权益保障"),
    Rule("工伤", ("工伤认定|工伤保险待遇|停工留薪期|一次性伤残补助金|伤残津贴|工伤医疗",), 0.95, "权益保障"),
    Rule("社保", ("社会保险|社保补缴|未缴纳社保|住房公积金|养老保险|医疗保险",), 0.85, "权益保障"),
    Rule("严重违纪", ("严重违纪|严重违反用人单位的规章制度|严重违反劳动纪律|违反公司规定",), 0.95, "解除终止"),
    Rule("旷工", ("旷工|无故缺勤|连续旷工|擅自离岗|脱岗|未按规定请假",), 0.9, "管理履约"),
    Rule("不能胜任工作", ("不能胜任工作|不胜任|绩效不合格|经培训或者调整工作岗位|试用期不符合录用条件",), 0.9, "解除终止"),
    Rule("试用期", ("试用期|试用期内|录用条件|试用期工资|试用期解除",), 0.9, "管理履约"),
    Rule("规章制度", ("规章制度|员工手册|奖惩制度|考勤管理制度|公司制度",), 0.85, "管理履约"),
]

DEFENSES = [
    Rule("严重违纪", ("严重违纪|严重违反用人单位规章制度|严重违反劳动纪律|存在严重违纪行为|违规违纪", "依据《劳动合同法》第三十九条.*解除|解除劳动合同合法合规|违纪辞退"), 0.9, "", ("被申请人(?:辩称|主张|认为|主张其系因|提交证据证明).*?(?:严重违纪|严重违反公司制度|严重违反劳动纪律)", "被申请人系以申请人(?:严重违纪|严重违反制度)为由解除")),
    Rule("旷工", ("旷工|连续旷工|擅自离岗|累计旷工|旷工达[0-9]+天|未请假擅自离岗|旷工属于严重违纪", "按自动离职处理|按旷工严重违纪解除"), 0.9, "", ("被申请人(?:辩称|主张|提交考勤).*?(?:旷工|连续旷工|未履行请假手续|脱岗)", "被申请人以申请人旷工为由.*?(?:解除|辞退|终止)")),
    Rule("不能胜任工作", ("不能胜任工作|绩效不合格|经考核不合格|经培训.*仍不能胜任|调整岗位.*仍不能胜任", "依据《劳动合同法》第四十条.*解除|考核等级为[D|E|不合格]"), 0.9, "", ("被申请人(?:辩称|主张).*?(?:不能胜任工作|绩效考核不达标|不胜任)", "被申请人以申请人不能胜任工作为由解除")),
    Rule("规章制度依据", ("员工手册|规章制度|考勤管理办法|奖惩管理制度|制度已向申请人公示|申请人已签收制度|民主程序制定", "依据公司《[^》]+制度》|制度合法有效"), 0.85, "", ("被申请人(?:辩称|提交).*?(?:规章制度已公示|已签收员工手册|制度履行了民主程序)",)),
    Rule("协商解除", ("双方协商一致解除|协商解除|达成离职协议|签署离职证明|申请人自愿签署解除协议", "依据《劳动合同法》第三十六条|已全额结清补偿"), 0.9, "", ("被申请人(?:辩称|主张).*?(?:双方系协商一致解除|达成离职补偿协议)",)),
    Rule("客观情况重大变化", ("客观情况发生重大变化|致使劳动合同无法履行|部门撤销|业务关停|项目终止|未能就变更合同达成协议", "依据《劳动合同法》第四十条第(?:三|\\(三\\)|3)项"), 0.9, "", ("被申请人(?:辩称|主张).*?(?:客观情况发生重大变化|组织架构调整导致岗位取消)",)),
    Rule("调岗合理", ("调岗具有合理性|用人单位自主用工权|生产经营需要|合理调整岗位|薪资待遇未降低|属于合理用工管理", "拒绝合理调岗|不服从合理工作安排"), 0.85, "", ("被申请人(?:辩称|主张).*?(?:调岗属于合理行使用工自主权|调岗具有必要性与合理性)",)),
    Rule("劳动者主动辞职", ("申请人主动辞职|个人原因辞职|主动提出离职|提交辞职信|提交离职申请|自愿离职|擅自离职", "并非用人单位辞退|系劳动者单方辞职"), 0.95, "", ("被申请人(?:辩称|主张).*?(?:申请人系因个人原因辞职|自愿提出离职|并非被申请人解除)",)),
    Rule("试用期不符合录用条件", ("试用期不符合录用条件|试用期考核不合格|未达到录用标准|录用条件已明确告知", "依据《劳动合同法》第三十九条第(?:一|\\(一\\)|1)项"), 0.9, "", ("被申请人(?:辩称|主张).*?(?:在试用期内不符合录用条件|试用期考核不达标)",)),
    Rule("竞业限制", ("违反竞业限制义务|入职竞争对手公司|自营同类业务|应支付违约金|返还竞业限制补偿金", "竞业限制协议有效|已按期足额支付竞业限制补偿"), 0.9, "", ("被申请人(?:辩称|反请求|主张).*?(?:申请人违反竞业限制|入职同业竞品公司)",)),
    Rule("加班不存在", ("不存在加班事实|未安排加班|未履行加班审批手续|实行不定时工作制|实行综合计算工时制", "申请人未提交有效证据证明加班|考勤记录无加班打卡"), 0.9, "", ("被申请人(?:辩称|主张).*?(?:申请人未实际加班|不存在加班事实|未经过加班审批)",)),
    Rule("工资已经支付", ("工资已足额发放|已全额结清工资|不存在拖欠工资|银行转账记录证明工资已结清|提成已按约定支付", "双方无工资拖欠争议|工资发放符合约定"), 0.9, "", ("被申请人(?:辩称|主张|提交银行流水).*?(?:工资已全额支付|已足额结清全部报酬)",)),
]

EVIDENCE = [
    Rule("员工手册", ("《员工手册》|员工手册签收表|员工手册培训记录|员工守则",)),
    Rule("规章制度", ("规章制度|考勤管理制度|奖惩管理办法|薪酬管理办法|制度公示记录|民主协商纪要",)),
    Rule("考勤记录", ("考勤记录|打卡记录|门禁打卡表|指纹打卡数据|钉钉打卡明细|考勤汇总表|电子考勤表",)),
    Rule("工资表", ("工资表|工资条|薪酬发放明细表|工资签收表|绩效核算表|提成结算表",)),
    Rule("银行流水", ("银行流水|银行对账单|代发工资转账凭证|电子回单|网银转账记录",)),
    Rule("微信聊天", ("微信聊天记录|微信群聊记录|微信转账记录|工作微信沟通记录",)),
    Rule("邮件", ("电子邮件|工作邮件|企业邮箱往来邮件|邮件通知|发送邮件记录",)),
    Rule("录音", ("通话录音|录音光盘|现场沟通录音|录音文字整理件|录音资料",)),
    Rule("录像", ("现场监控录像|视频光盘|监控视频资料|视频记录",)),
    Rule("解除通知书", ("解除劳动合同通知书|终止劳动合同通知书|辞退通知书|解聘通知书|离职证明书",)),
    Rule("警告通知", ("警告通知书|违纪处分通知书|严重警告信|违规通报|整改通知书",)),
    Rule("绩效考核", ("绩效考核表|KPI评分表|月度绩效确认单|季度考核结果|不胜任工作评估表",)),
    Rule("劳动合同", ("劳动合同书|书面劳动合同|劳动用工合同|劳动合同文本",)),
    Rule("补充协议", ("补充协议|岗位调整协议|薪酬变更协议|保密及竞业限制协议",)),
    Rule("证人证言", ("证人证言|证人出庭作证|同事书面证明|第三方证言",)),
]

LOSSES = [
    Rule("证据不足", ("证据不足|未提交充分证据|现有证据不足以证明|证据尚不足以采信|缺乏充分证据支持",), 0.9),
    Rule("举证不能", ("承担举证不能的法律后果|应承担举证不能的责任|未尽到举证责任|举证责任在被申请人.*未举证", "依据《劳动争议调解仲裁法》第六条.*举证不能"), 0.95),
    Rule("无法证明", ("无法证明|未能证明|不足以证明申请人存在|未能有效证明|无法证实",), 0.85),
    Rule("事实依据不足", ("缺乏事实依据|事实依据不足|无事实依据|认定事实缺乏根据",), 0.9),
    Rule("制度未公示", ("未向劳动者公示|未送达劳动者|未能证明已向申请人送达或告知|未履行告知义务|无签收确认记录", "规章制度未经公示|未向申请人公示或告知"), 0.95),
    Rule("制度未经民主程序", ("未经职工代表大会或者全体职工讨论|未经过民主协商程序|未履行法定民主程序|民主程序存在瑕疵", "依据《劳动合同法》第四条.*民主程序"), 0.95),
    Rule("解除程序违法", ("解除程序违法|单方解除程序不符合法律规定|未依法事先通知工会|解除劳动合同程序不合法", "依据《劳动合同法》第四十三条"), 0.95),
    Rule("通知程序违法", ("未履行通知义务|未有效送达解除通知|送达程序违法|通知工会程序缺失|未提前三十日书面通知",), 0.9),
    Rule("违纪事实不能成立", ("违纪事实不成立|违纪行为不能成立|主张的严重违纪缺乏事实根据|违纪情节不能成立",), 0.95),
    Rule("严重程度不足", ("未达到严重违纪程度|违纪行为尚未达到严重程度|用人单位处分畸重|违纪情节轻微|严重程度不足以解除",), 0.9),
    Rule("证据真实性问题", ("申请人不予认可真实性|真实性无法确认|无法核实真实性|证据真实性存疑|未提供原件核对",), 0.9),
    Rule("证据关联性不足", ("与本案缺乏关联性|不具有关联性|未能证明与本案主张存在直接关联|关联性不足",), 0.85),
    Rule("证据合法性问题", ("取证程序不合法|证据来源不合法|侵害他人合法权益取得|合法性存在瑕疵",), 0.95),
]

#: Sections of arbitration awards: name, what opens them, what ends them.
SECTIONS = [
    ("claims", "申请人(?:向本委)?(?:提出|主张|诉称|申诉称|仲裁请求)[：:\\s]*", "被申请人(?:辩称|答辩|答辩称|称)|经(?:本委)?审理查明|经查明|本委查明|双方无争议事实"),
    ("respondent", "被申请人(?:辩称|答辩|答辩称|辩诉|答称|主张)[：:\\s]*", "经(?:本委)?审理查明|经查明|本委查明|本委认为|仲裁庭认为|仲裁庭评述|依照.*裁决如下|裁决如下"),
    ("evidence", "(?:为证明其主张|证据(?:如下|名称|清单)|当事人围绕仲裁请求提交证据|举证质证情况|当事人举证质证)[：:\\s]*", "经(?:本委)?审理查明|本委认为|仲裁庭认为|裁决如下"),
    ("facts", "(?:经(?:本委)?审理查明|本委查明事实如下|查明事实|查明如下|经审理查明)[：:\\s]*", "本委认为|仲裁庭认为|仲裁庭评述|仲裁庭认定|依照.*裁决如下|裁决如下"),
    ("reasoning", "(?:本委认为|仲裁庭认为|仲裁庭评述|仲裁庭认定|关于.*问题，本委认为)[：:\\s]*", "综上|依照|依据|裁决如下|裁决结果"),
    ("decision", "(?:裁决如下|裁决结果)[：:\\s]*", "如不服本裁决|当事人如不服|双方当事人如不服|本裁决为终局裁决|本裁决为非终局裁决"),
]
#: Sections of court judgments; those with a number are clipped to so many characters.
COURT_SECTIONS = [
    ("respondent", "(?:被告|被上诉人|被申请人|公司|用人单位)(?:辩称|答辩称|答辩|称|主张)[，：:\\s]+", "经审理查明|本院经审理查明|查明|本案相关情况|仲裁庭查明|法院查明|本院认为|仲裁庭认为|本院经审理认为|本庭认为", 1500),
    ("facts", "(?:经审理查明|本院经审理查明|查明|本案相关情况|仲裁庭查明|法院查明)[，：:\\s]+", "本院认为|法院认为|本院经审理认为|本院认为：|经审理，本院认为|本院综合认为|综上|本院评析|裁判理由|仲裁庭认为|本庭认为|依照《", 0),
    ("reasoning", "(?:本院认为|法院认为|本院经审理认为|本院认为：|经审理，本院认为|本院综合认为|本院评析|裁判理由|仲裁庭认为|本庭认为)[，：:\\s]+", "判决如下|裁决如下|裁定如下|据此|综上，依照|综上所述，依照", 0),
    ("decision", "(?:综上[，,、\\s]*(?:本院)?判决如下|本院判决如下|判决如下|判决|裁决如下|裁定如下)[：:\\s]+", "如不服|审\\s*判\\s*长|审\\s*判\\s*员|仲\\s*裁\\s*员|书\\s*记\\s*员|\\z", 0),
]
BOILERPLATE = ["深圳市人力资源和社会保障局\\s*公开裁决文书", "免责声明[：:][^\\n]*", "技术支持[：:][^\\n]*", "页面生成时间[：:][^\\n]*", "本网站所有内容仅供参考[^\\n]*", "【打印本页】|【关闭窗口】|【返回顶部】"]
ARTICLE = "《([^》]+)》[第\\s]*([0-9一二三四五六七八九十百]+)\\s*条(?:[第\\s]*([0-9一二三四五六七八九十]+)\\s*款)?(?:[第\\s]*([0-9一二三四五六七八九十]+)\\s*项)?"
CASE_NUMBER = "(?:深|粤)[0-9a-zA-Z一-龥（(\\[{【]{2,8}[0-9]{4}[）)\\]}】][0-9a-zA-Z一-龥]{0,8}第?[0-9一二三四五六七八九十]+号"
COMMITTEE = "深圳市(?:[一-龥]{2,6}区)?劳动(?:人事)?争议仲裁委员会"
DEFAULT_COMMITTEE = "深圳市劳动人事争议仲裁委员会"
DATES = "[12][0-9]{3}年[01]?[0-9]月[0-3]?[0-9]日"
PAID = "(?:支付|赔偿|补偿|返还|金额为?)[^\\d\\n。]{0,8}([0-9]+(?:\\.[0-9]{1,2})?)\\s*元"

#: Dispute types of court judgments with their key words; some look at a text without phrases that mislead.
MISLEADING = {"compensation": ["未依法缴纳社会保险经济补偿金", "社会保险补偿", "代通知金"], "termination": ["违法解除劳动合同赔偿金", "解除劳动合同经济补偿金"]}
DISPUTE_TYPES = [
    ("违法解除赔偿金", "", ("违法解除劳动合同赔偿金", "违法辞退赔偿金", "违法解除赔偿金")),
    ("劳动合同解除", "termination", ("违法解除", "解除劳动合同", "终止劳动合同", "辞退", "开除", "通知工会", "严重违反规章制度", "旷工解除", "协商解除", "被迫解除", "被迫离职", "第三十九条", "第39条", "第四十条", "第40条", "第四十六条", "第46条", "第八十七条", "第87条", "赔偿金")),
    ("经济补偿金", "compensation", ("经济补偿金", "经济补偿", "N+1", "代通知金及经济补偿", "未提前三十日", "法定经济补偿", "工作年限补偿")),
    ("代通知金", "", ("代通知金", "提前一个月通知")),
    ("社会保险争议", "", ("补缴社会保险", "未依法缴纳社会保险", "社会保险补偿", "补缴社保", "社会保险与公积金", "养老保险", "医疗保险")),
    ("加班工资", "", ("加班工资", "加班费", "延时工作加班费", "延时加班", "休息日加班", "法定节假日加班", "周末加班", "打卡记录", "考勤记录", "综合计算工时", "不定时工作制", "计件加班")),
    ("未签劳动合同二倍工资", "", ("未签书面劳动合同", "未签订劳动合同", "二倍工资", "双倍工资", "第八十二条", "第82条", "事实劳动关系", "补签劳动合同")),
    ("工伤与工伤待遇", "", ("工伤", "工伤认定", "停工留薪期工资", "伤残补助金", "一次性工伤医疗补助金", "一次性伤残就业补助金", "伤残津贴", "工伤医疗费", "工伤保险待遇", "劳动能力鉴定")),
    ("竞业限制", "", ("竞业限制", "竞业限制补偿金", "竞业违约金", "保密协议", "商业秘密", "第二十三条", "第二十四条", "竞业限制期")),
    ("工资报酬与绩效奖金", "", ("拖欠工资", "克扣工资", "绩效工资", "年终奖", "提成", "业务提成", "十三薪", "佣金", "岗位津贴", "高温津贴", "未足额支付")),
    ("试用期争议", "", ("试用期", "试用期不符合录用条件", "试用期解除", "第十九条", "第二十条", "录用条件")),
]
#: Tags of arbitration awards, and of imported pages.
AWARD_TAGS = [
    ("违法解除", ("违法解除", "旷工", "严重违反", "违纪解除", "单方解除", "辞退", "开除", "第三十九条", "第39条", "第八十七条", "第87条", "通知工会")),
    ("加班工资", ("加班费", "加班工资", "延时工作", "法定节假日加班", "休息日加班", "计件加班", "综合工时", "考勤记录", "打卡记录", "工资支付条例")),
    ("经济补偿", ("经济补偿", "经济补偿金", "第四十六条", "第四十七条", "第46条", "第47条", "协商解除", "被迫辞职", "未及时足额支付")),
    ("未签劳动合同", ("未签书面劳动合同", "未签订劳动合同", "二倍工资", "双倍工资", "第八十二条", "第82条", "事实劳动关系")),
    ("调岗降薪", ("调岗", "降薪", "调整工作岗位", "变动工作地点", "工作地点变更", "用工自主权", "职务调整")),
    ("年终奖与绩效", ("年终奖", "绩效", "提成", "奖金", "考核", "KPI", "绩效工资", "第十三薪")),
    ("工伤待遇", ("工伤", "工伤认定", "停工留薪", "伤残补助金", "医疗费", "一次性工伤医疗补助金")),
    ("竞业限制", ("竞业限制", "竞业补偿金", "商业秘密", "保密协议", "竞业违约金", "第二十三条", "第23条")),
    ("试用期争议", ("试用期", "不符合录用条件", "试用期解除", "第十九条", "第二十条")),
    ("社会保险", ("社会保险", "社保", "公积金", "补缴社保", "住房公积金")),
]
PAGE_CITIES = ["东莞", "深圳", "广州", "佛山", "惠州", "中山", "珠海"]
PAGE_TAGS = [
    ("违法解除", ("违法解除", "旷工", "严重违纪", "违纪解除", "单方解除", "辞退", "开除", "第39条", "第三十九条", "第八十七条", "87条")),
    ("加班工资", ("加班费", "加班工资", "延时工作", "法定节假日加班", "休息日加班", "计件加班", "工时", "考勤打卡")),
    ("调岗", ("调岗", "降薪", "调整工作岗位", "工作地点变更", "变动工作地点", "职务调整")),
    ("竞业限制", ("竞业限制", "商业秘密", "保密协议", "竞业补偿金", "竞业违约金")),
    ("经济补偿", ("经济补偿", "经济补偿金", "解除劳动合同经济补偿", "裁员补偿", "第四十六条", "第四十七条", "46条", "47条", "赔偿金")),
    ("劳动合同", ("未签书面劳动合同", "未签订劳动合同", "二倍工资", "双倍工资", "事实劳动关系", "劳动合同确认")),
    ("工伤", ("工伤", "工伤待遇", "工伤保险", "伤残补助金", "医疗费", "停工留薪", "职业病")),
    ("绩效", ("绩效", "年终奖", "提成", "奖金", "考核", "KPI", "绩效工资")),
]
#: Claims in the order in which they are looked for: name, type, key words.
CLAIMS = [(r.name, r.type, r.words) for r in CLAIM_RULES]
#: What a clause of a decision orders, in order of precedence.
ACTIONS = [
    ("reject", "驳回|不予支持|无需支付|不予处理|不属于(?:人民法院|民事诉讼|劳动争议)"),
    ("support", "予以支持|支持|确认[^。；，,]*(?:劳动关系|劳动合同关系)?(?:已经|已)?解除"),
    ("pay", "支付|补缴|补发"),
    ("maintain", "维持(?:原判|原裁决)"),
    ("revoke", "撤销"),
]
TARGETS = [("appellant", "驳回上诉"), ("defendant", "被告[^。；，,]*(?:反诉|请求)"), ("appellee", "被上诉人"), ("appellant", "上诉人|上诉请求"), ("plaintiff", "原告|申请人")]
#: Key points of a reasoning: all groups of words must have one found.
KEY_POINTS = [
    ("举证责任分配：用人单位/劳动者对相关主张承担举证证明责任", [("举证责任", "谁主张谁举证")]),
    ("规章制度合法性：审查规章制度是否经过民主制定程序及向劳动者公示送达", [("规章制度",), ("民主程序", "公示")]),
    ("旷工认定尺度：审查员工未出勤原因的合理性与用人单位制度依据", [("旷工",), ("严重", "合理")]),
    ("解除程序审查：单方解除用人单位是否履行事先通知工会法定程序", [("工会",), ("通知",)]),
    ("加班工资认定：考勤记录、加班审批与用人单位掌握考勤证据的举证倒置责任", [("加班",), ("考勤", "审批")]),
    ("二倍工资差额：未签劳动合同二倍工资的支付期限与仲裁时效认定", [("二倍工资",), ("时效",)]),
    ("解除性质与经济责任：界定劳动关系解除类型及法定经济补偿/赔偿金责任", [("经济补偿金", "赔偿金")]),
]
NO_KEY_POINT = "本案核心争议焦点：劳动合同履行、解除合法性及经济补偿清算"
#: Kinds of evidence in court judgments: name, key words, the sentence part around them.
EVIDENCE_KINDS = [
    ("劳动合同/协议", ("劳动合同", "聘用协议", "劳动合同书", "续签劳动合同"), "《?劳动合同(?:书)?》?|聘用协议|书面劳动合同"),
    ("规章制度/员工手册", ("规章制度", "员工手册", "考勤管理制度", "奖惩制度", "签字确认表", "民主程序"), "《员工手册》|《考勤管理制度》|《规章制度》|规章制度|员工手册|管理办法"),
    ("考勤记录/打卡数据", ("考勤记录", "打卡记录", "指纹考勤", "钉钉打卡", "企业微信打卡", "出勤表", "打卡流水"), "考勤表|打卡记录|钉钉打卡|出勤记录|指纹打卡|考勤记录"),
    ("工资支付/银行流水", ("银行流水", "工资条", "工资支付凭证", "个税完税证明", "银行转账记录", "薪资明细", "工资表"), "银行流水|工资条|工资明细表|完税证明|工资发放|转账记录|工资表"),
    ("电子沟通/通知记录", ("聊天记录", "微信记录", "电子邮件", "钉钉", "通知", "函件", "EMS凭证", "录音", "录像"), "微信聊天记录|聊天记录|电子邮件|EMS|送达回执|钉钉|通知书|录音|录像"),
    ("离职/处分证明", ("辞退通知", "解除劳动合同通知书", "离职申请", "警告记录", "处罚通知", "调解书"), "辞退通知|解除(?:劳动)?合同通知书|离职申请|处分通知|处罚通知|调解书|裁决书|决定书"),
    ("社保/工伤记录", ("社保记录", "工伤认定书", "缴纳证明", "社保", "鉴定结论"), "社保记录|工伤认定书|缴纳证明|社会保险|劳动能力鉴定"),
]
HANDED_IN = "提交|提供|出示|举证|调取|收集|提取|取得"
#: Defences in court judgments: name, key words, the sentence part around them.
DEFENSE_KINDS = [
    ("旷工 / 擅自离岗", ("旷工", "连续旷工", "累计旷工", "擅自离职", "未履行请假手续", "脱岗", "未按时打卡出勤", "迟到早退"), "旷工|累计旷工|连续旷工达|未经批准擅自|未办理请假手续|脱岗|迟到早退"),
    ("严重违纪 / 违反规章制度", ("严重违反规章制度", "严重违纪", "员工手册", "考勤管理制度", "违纪行为", "第三十九条第二项", "严重失职", "违反公司制度"), "严重违反(?:用人单位|公司)?规章制度|严重违纪|违反员工手册|严重失职|营私舞弊|违反公司制度"),
    ("不能胜任工作 / 考核不达标", ("不胜任工作", "考核不达标", "绩效不合格", "未能完成工作任务", "第四十条第二项", "调岗培训", "不能胜任工作", "绩效考核不合格"), "不胜任(?:本职)?工作|不能胜任工作|绩效考核不合格|考核结果不达标|经培训后仍不胜任"),
    ("协商一致解除 / 自愿离职", ("协商一致解除", "双方协商解除", "协议解除", "签署解除协议", "自愿离职", "辞职信", "员工主动辞职", "自动离职"), "协商一致解除|双方协商同意解除|签署了?离职协议|主动提出离职|提交辞职信|自愿离职|自动离职|员工主动辞职"),
    ("试用期不符合录用条件", ("试用期不符合录用条件", "录用条件", "试用期考核不合格", "试用期解除", "不符合岗位要求"), "在试用期(?:间)?被证明不符合录用条件|试用期考核不合格|未通过试用期考察|不符合录用条件"),
    ("劳动合同期满终止", ("合同期满终止", "期满不续签", "劳动合同到期", "终止劳动合同通知", "合同期满"), "劳动合同期满(?:终止)?|合同到期不续签|期满自然终止|劳动合同到期"),
    ("已足额支付劳动报酬/已结清", ("已足额支付", "不存在拖欠", "工资已结清", "包含在固定工资中", "已发放完毕", "无未结款项", "不存在加班", "已支付工资", "已支付经济补偿"), "已按月足额发放|工资已全部结清|不存在拖欠|已支付全部加班费|不存在加班|已支付工资|已支付经济补偿"),
    ("客观情况发生重大变化", ("客观情况发生重大变化", "部门撤销", "组织架构调整", "业务关停", "第四十条第三项"), "客观情况发生重大变化|组织架构调整|岗位取消|部门撤销"),
    ("不服从安排 / 拒绝调岗", ("拒不服从工作安排", "拒绝调岗", "拒绝加班", "不服从管理"), "拒不服从工作安排|拒绝调岗|拒绝加班|不服从管理"),
    ("不存在劳动关系 / 未建立劳动关系", ("未形成劳动关系", "不属于劳动关系", "不存在劳动关系"), "未形成劳动关系|不属于劳动关系|不存在劳动关系"),
    ("证据真实性/合法性/关联性异议", ("真实性异议", "不予认可", "伪造", "关联性异议", "合法性异议"), "对真实性有异议|不予认可|对合法性有异议|对关联性有异议|不予确认"),
]
EVIDENCE_NAMES = [
    ("离职申请/离职手续材料", "离职申请单|离职申请表|离职手续表|辞职书|辞职信"),
    ("试用期考核材料", "试用期评定|试用期考核|转正考核|试用期评估"),
    ("劳动合同", "劳动合同书|劳动合同"),
    ("规章制度", "规章制度|员工手册|奖惩规定"),
    ("考勤记录", "考勤记录|打卡记录|考勤表|指纹打卡"),
    ("工资及支付凭证", "工资单|工资条|银行流水|转账凭证|工资流水"),
    ("解除劳动关系通知书", "解除劳动合同通知书|开除通知|辞退通知|辞退书"),
    ("电子沟通记录", "微信聊天|钉钉聊天|聊天记录|邮件沟通"),
    ("送达与签收凭证", "送达回证|邮寄凭证|签收单"),
]
COURT_CODES = [
    ("粤01", "广州"), ("粤02", "韶关"), ("粤03", "深圳"), ("粤04", "珠海"), ("粤05", "汕头"), ("粤06", "佛山"), ("粤07", "江门"), ("粤08", "湛江"), ("粤09", "茂名"), ("粤12", "肇庆"),
    ("粤13", "惠州"), ("粤14", "梅州"), ("粤15", "汕尾"), ("粤16", "河源"), ("粤17", "阳江"), ("粤18", "清远"), ("粤19", "东莞"), ("粤20", "中山"), ("粤71", "广州"),
    ("京", "北京"), ("沪", "上海"), ("津", "天津"), ("渝", "重庆"), ("浙01", "杭州"), ("浙02", "宁波"), ("苏01", "南京"), ("苏05", "苏州"),
]
LEGAL_TERMS = [
    "违法解除", "经济补偿", "赔偿金", "严重违纪", "不能胜任工作", "旷工", "未签劳动合同", "双倍工资", "加班工资", "年休假工资", "调岗降薪", "竞业限制", "员工手册", "考勤记录",
    "工资表", "银行流水", "解除通知书", "绩效考核", "试用期", "录用条件", "规章制度", "民主程序", "公示告知", "事实劳动关系", "工伤认定", "停工留薪期", "医疗期", "生活费",
    "保密协议", "违约金", "证明责任", "举证不能", "通知工会", "不予支持", "驳回仲裁请求", "全额支持",
]
SYNONYMS = {
    "违法解除劳动合同": "违法解除", "解除劳动合同": "解除劳动关系", "解除劳动关系": "解除合同", "辞退": "违法解除", "开除": "严重违纪解除", "经济补偿金": "经济补偿", "双倍工资": "未签合同双倍工资", "加班费": "加班工资",
    "延长工作时间加班": "平时加班", "休息日加班": "周末加班", "法定节假日加班": "节假日加班", "带薪年休假": "年休假", "不胜任工作": "不能胜任工作", "考核不合格": "不能胜任工作",
}
STOP_WORDS = [
    "的", "了", "和", "是", "就", "都", "而", "及", "与", "在", "之", "由", "向", "其",
    "我", "该", "此", "按", "根据", "依照", "关于", "对于", "由于", "为了", "本委", "仲裁委", "仲裁庭", "申请人",
    "被申请人", "双方", "当事人", "原告", "被告", "深圳市", "劳动人事争议仲裁委员会", "裁决书", "决定书", "通知书", "案号", "号", "经审理查明", "本委查明",
    "本委认为", "裁决如下", "综上所述", "事实清楚", "证据确凿", "予以支持", "不予支持", "予以采信", "不予采信", "应当", "可以", "不得", "规定", "元",
    "日", "月", "年", "款", "条", "项", "第", "一份", "一份案", "相关", "以及", "并", "等", "至",
    "自", "于", "已", "未", "向本委", "提出", "请求", "主张", "辩称", "称", "答辩", "审理", "确认", "履行",
    "发生", "产生",
]
LAWS = [
    "《中华人民共和国劳动合同法》", "《中华人民共和国劳动争议调解仲裁法》", "《中华人民共和国劳动法》", "《中华人民共和国社会保险法》",
    "《深圳经济特区和谐劳动关系促进条例》", "《深圳市员工工资支付条例》", "《工伤保险条例》",
]
