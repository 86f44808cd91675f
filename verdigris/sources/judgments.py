"""Texts of awards and court judgments, one for each order, to run the text rules on.

The stored tables have no such texts, so they are put together from phrases by
the order's key, its date and its price; ``TEXTS`` and ``COURT`` are the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.tables import table

PARTS = {
    "district": (1, ["福田区", "南山区", "宝安区", ""]),
    "person": (3, ["张三", "李小明", "王芳", "欧阳建国"]),
    "company": (5, ["深圳市某某科技有限公司", "广东某某电子厂", "某某物流企业"]),
    "claim": (2, ["支付违法解除劳动合同赔偿金", "支付经济补偿金", "支付加班工资", "支付未休年休假工资", "支付双倍工资差额", "补缴社会保险费", "确认事实劳动关系并支付拖欠工资"]),
    "claim2": (7, ["支付代通知金5000元", "支付绩效工资和年终奖", "支付一次性伤残补助金及停工留薪期工资", "返还保密协议违约金"]),
    "defense": (3, ["申请人连续旷工，严重违纪，公司依据《考勤管理制度》解除", "申请人不能胜任工作，经考核不合格，调整工作岗位后仍不胜任", "双方协商一致解除，申请人自愿离职", "不存在加班事实，工资已足额发放，不存在拖欠工资", "因客观情况发生重大变化，部门撤销", "申请人试用期不符合录用条件，已向其公示规章制度", "否认全部主张"]),
    "evidence": (5, ["《员工手册》、考勤记录及打卡记录", "工资表和银行流水", "微信聊天记录与电子邮件", "解除劳动合同通知书、劳动合同书", "证人证言、通话录音", "工伤认定书和社保记录"]),
    "reason": (2, ["被申请人未尽到举证责任，现有证据不足以证明旷工严重，未依法事先通知工会", "规章制度未经公示，未履行法定民主程序，缺乏事实依据", "考勤记录与加班审批可以互相印证，予以采信", "违纪情节轻微，未达到严重违纪程度，应支付赔偿金", "双方对二倍工资的仲裁时效有争议", "证据真实性无法确认，与本案缺乏关联性", "双方意见一致"]),
    "article": (1, ["三十九", "四十六", "四十七", "八十二", "87", "十第2款"]),
    "tail": (3, ["驳回申请人的其他仲裁请求", "驳回申请人的全部仲裁请求", "对第一项请求予以支持，其余请求不予支持", "确认双方劳动关系已解除"]),
    "foot": (2, ["深圳市人力资源和社会保障局 公开裁决文书", "免责声明：本页仅供参考", "【打印本页】【关闭窗口】", ""]),
}


def _spark(name: str) -> Column:
    step, options = PARTS[name]
    return F.get(F.array(*map(F.lit, options)), (F.floor(F.col("o_orderkey") / step) % len(options)).cast("int"))


def dealt(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """The rows of a few files dealt to all cores: the rules take far longer than the scan, so a file, or a large part of one, shouldn't be one task."""
    tasks = 3 * spark.sparkContext.defaultParallelism
    return orders.repartition(tasks) if orders.rdd.getNumPartitions() < tasks else orders


def award_texts(spark: SparkSession, d: str, deal: bool = False) -> DataFrame:
    """case_id, text, filed (date), amount (whole price) of each order; ``deal`` for work that takes far longer than the scan."""
    amount, at = F.floor("o_totalprice").cast("string"), F.col("o_orderdate")
    award = F.floor(F.col("o_totalprice") / (1 + F.col("o_orderkey") % 3)).cast("string")
    pieces = [
        "深圳市", _spark("district"), "劳动人事争议仲裁委员会\n仲裁裁决书\n深劳人仲案（", F.year(at).cast("string"), "）", F.col("o_orderkey").cast("string"), "号\n申请人：", _spark("person"), "，男。\n被申请人：", _spark("company"),
        "，住所地深圳市。\n申请人主张：1、", _spark("claim"), amount, "元；2、", _spark("claim2"), "。\n被申请人辩称：", _spark("defense"), "。被申请人提交", _spark("evidence"), "。\n经审理查明：申请人于", F.year(at).cast("string"), "年", F.month(at).cast("string"), "月",
        F.day(at).cast("string"), "日入职，月工资", F.floor(F.col("o_totalprice") / 12).cast("string"), "元。\n本委认为：", _spark("reason"), "。依照《中华人民共和国劳动合同法》第", _spark("article"), "条之规定，裁决如下：\n一、被申请人", _spark("claim"), award, "元；\n二、",
        _spark("tail"), "。\n如不服本裁决，可向人民法院起诉。\n", _spark("foot"),
    ]
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return (dealt(spark, orders) if deal else orders).select(F.col("o_orderkey").alias("case_id"), text.alias("text"), F.to_date("o_orderdate").alias("filed"), F.floor("o_totalprice").cast("long").alias("amount"))


def _sql(name: str) -> str:
    step, options = PARTS[name]
    return "[" + ", ".join(f"'{o}'" for o in options) + f"][1 + (o_orderkey // {step}) % {len(options)}]"


_LINE = "chr(10)"
TEXTS = (
    "texts AS (SELECT o_orderkey AS case_id, o_orderdate::DATE AS filed, floor(o_totalprice)::BIGINT AS amount, concat('深圳市', " + _sql("district") + f", '劳动人事争议仲裁委员会', {_LINE}, '仲裁裁决书', {_LINE}, '深劳人仲案（', year(o_orderdate), '）', o_orderkey, '号', {_LINE}, '申请人：', "
    + _sql("person") + f", '，男。', {_LINE}, '被申请人：', " + _sql("company") + f", '，住所地深圳市。', {_LINE}, '申请人主张：1、', " + _sql("claim") + ", floor(o_totalprice)::BIGINT, '元；2、', " + _sql("claim2") + f", '。', {_LINE}, '被申请人辩称：', " + _sql("defense") + ", '。被申请人提交', " + _sql("evidence")
    + f", '。', {_LINE}, '经审理查明：申请人于', year(o_orderdate), '年', month(o_orderdate), '月', day(o_orderdate), '日入职，月工资', floor(o_totalprice / 12)::BIGINT, '元。', {_LINE}, '本委认为：', " + _sql("reason") + ", '。依照《中华人民共和国劳动合同法》第', " + _sql("article")
    + f", '条之规定，裁决如下：', {_LINE}, '一、被申请人', " + _sql("claim") + f", floor(o_totalprice / (1 + o_orderkey % 3))::BIGINT, '元；', {_LINE}, '二、', " + _sql("tail") + f", '。', {_LINE}, '如不服本裁决，可向人民法院起诉。', {_LINE}, " + _sql("foot") + ") AS text FROM orders)"
)


#: Court judgments: $p is a person, $c a firm, $a and $b amounts asked and awarded, $k and $m claims, $d a decision.
COURT_PARTS = {
    "form": (1, [
        "民事判决书\n原告：$p，女。\n被告：$c，住所地深圳市。\n原告$p向本院提出诉讼请求：1.判令被告支付$k$a元；2.判令被告支付$m$b元。\n被告辩称：不存在拖欠，$k请求无依据。\n经审理查明：双方签有合同。\n本院认为：$m请求有部分依据。\n判决如下：\n$d\n如不服本判决，可以上诉。",
        "原告：$c。被告：$p。原告请求确认无需支付$k$a元，被告请求支付$k。判决如下：驳回公司的全部诉讼请求；$c支付$p$k$b元。",
        "上诉人（原审被告）：$c。被上诉人（原审原告）：$p。上诉人请求撤销原判。原审判决如下：确认双方劳动合同关系已经解除；$c支付$p$k$b元。二审判决如下：驳回上诉，维持原判。",
        "上诉人：$c。被上诉人：$p。仲裁请求：请求支付$k$a元。上诉人$c认为原判认定$k错误。二审判决如下：$d",
        "申请人：$p。被申请人：$c。申请仲裁请求支付$k$a元及$m。裁决如下：被申请人支付申请人$k$b元；$d",
        "原告：$c。被告：乙有限公司。第三人：$p。员工：$p，$k请求见后。判决如下：$d",
        "原告：$p。被告：$c。被告$c提出反诉，请求确认无需支付$k$a元。原告请求支付$m$a元。工伤认定在前，判令被告支付停工留薪期工资。判决如下：被告支付原告$m$b元；驳回被告反诉请求。",
        "原告：$p。被告：$c。原告请求$k$a元、$m$b元和确认劳动关系解除。判决如下：上述请求中，第一、二项有事实依据，第三项不予支持；前两项请求予以支持；驳回其余诉讼请求；第九项另案处理。",
        "$c与$p劳动争议案。综上，$k没有证据。判决如下：$d",
        "",
    ]),
    "person": (7, ["张三", "李小明", "王芳", "欧阳建国"]),
    "firm": (3, ["深圳市某某科技有限公司", "广东某某电子厂", "某某培训中心"]),
    "claim": (2, ["违法解除劳动合同赔偿金", "经济补偿金", "加班工资", "未休年休假工资", "双倍工资差额", "一次性伤残补助金", "劳动报酬"]),
    "claim2": (5, ["代通知金", "护理费", "拖欠工资", "年休假工资", "补缴社会保险费"]),
    "decision": (4, ["被告支付原告$k$b元；驳回原告其他诉讼请求。", "驳回$k请求，支持$m$b元。", "驳回原告全部诉讼请求。", "确认双方劳动关系于2022年4月29日解除；支付$k$a元，予以全额支持。", "本案另行处理。", "$k不属于劳动争议；予以支持。", "驳回上诉，维持原判。"]),
}
_ORDER = [("$d", "decision"), ("$p", "person"), ("$c", "firm"), ("$k", "claim"), ("$m", "claim2")]


def _court_part(name: str) -> Column:
    step, options = COURT_PARTS[name]
    return F.get(F.array(*map(F.lit, options)), (F.floor(F.col("o_orderkey") / step) % len(options)).cast("int"))


def court_texts(spark: SparkSession, d: str) -> DataFrame:
    """case_id, text of a court judgment for each order; every 13th has the requests by themselves, every 11th a title."""
    text = _court_part("form")
    for token, name in _ORDER:
        text = F.replace(text, F.lit(token), _court_part(name))
    asked, awarded = F.floor("o_totalprice").cast("string"), F.floor(F.col("o_totalprice") / (1 + F.col("o_orderkey") % 3)).cast("string")
    text = F.replace(F.replace(text, F.lit("$a"), asked), F.lit("$b"), awarded)
    request = F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("原告向法院提出诉讼请求：请求支付"), _court_part("claim"), asked, F.lit("元。")))
    title = F.when(F.col("o_orderkey") % 11 == 0, F.concat(_court_part("person"), F.lit("与"), _court_part("firm"), F.lit("劳动争议一审民事判决书")))
    orders = dealt(spark, table(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    return orders.select(F.col("o_orderkey").alias("case_id"), text.alias("text"), title.alias("title"), request.alias("request"))


def _court_sql(name: str) -> str:
    step, options = COURT_PARTS[name]
    quoted = ", ".join("'" + o.replace("\n", "' || chr(10) || '") + "'" for o in options)
    return f"[{quoted}][1 + (o_orderkey // {step}) % {len(options)}]"


def _court_text_sql() -> str:
    out = _court_sql("form")
    for token, name in _ORDER:
        out = f"replace({out}, '{token}', {_court_sql(name)})"
    return f"replace(replace({out}, '$a', floor(o_totalprice)::BIGINT::VARCHAR), '$b', floor(o_totalprice / (1 + o_orderkey % 3))::BIGINT::VARCHAR)"


COURT = (
    f"court AS (SELECT o_orderkey AS case_id, {_court_text_sql()} AS text, CASE WHEN o_orderkey % 11 = 0 THEN {_court_sql('person')} || '与' || {_court_sql('firm')} || '劳动争议一审民事判决书' END AS title, "
    f"CASE WHEN o_orderkey % 13 = 0 THEN '原告向法院提出诉讼请求：请求支付' || {_court_sql('claim')} || floor(o_totalprice)::BIGINT || '元。' END AS request FROM orders)"
)
