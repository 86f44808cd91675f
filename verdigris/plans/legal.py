"""Queries of the rules over award texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import awards as aw
from verdigris.functions import dates, rules
from verdigris.functions import legal_tables as t
from verdigris.plans.registry import query
from verdigris.sources.judgments import TEXTS, award_texts



def the_text() -> Column:
    return F.col("text")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_lit(x) if isinstance(x, str) else str(x) for x in items) + "]"


def _rule_table(table: list[t.Rule], field: str = "patterns") -> str:
    """VALUES rows (name, weight, k, pattern) of a rule table."""
    rows = [f"({_lit(r.name)}, {r.weight}::DOUBLE, {i}, {k}, {_lit(p)})" for i, r in enumerate(table) for k, p in enumerate(getattr(r, field))]
    return f"(VALUES {', '.join(rows)}) AS r(name, weight, i, k, pattern)"


def _around(text: str, found: str, before: int, after: int) -> str:
    low = f"greatest(strpos({text}, {found}) - {before}, 1)"
    return f"trim(regexp_replace(substring({text}, {low}, strpos({text}, {found}) + length({found}) + {after} - {low}), '\\n+', ' ', 'g'))"


def _section(text: str, opens: str, ends: str, clip: int = 0) -> str:
    end = ends if ends.endswith("\\z") else f"{ends}|\\z"
    out = f"CASE WHEN regexp_matches({text}, {_lit(opens)}) THEN trim(regexp_extract({text}, {_lit(f'(?:{opens})([\\s\\S]*?)(?:{end})')}, 1), ' ' || chr(10) || chr(13) || chr(9) || '　') END"
    return f"substring({out}, 1, {clip})" if clip else out


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_lit(w)})" for w in (words.split() if isinstance(words, str) else words)) + ")"


def _names(text: str, table) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_any(text, words)} THEN {_lit(n)} END" for n, words in table) + "], lambda x: x IS NOT NULL)"


_CLEAN = "text"
for _p in t.BOILERPLATE:
    _CLEAN = f"regexp_replace({_CLEAN}, {_lit(_p)}, '', 'g')"
_CLEAN = f"trim({_CLEAN}, ' ' || chr(10) || chr(13) || chr(9))"
_SECTION = {name: (opens, ends) for name, opens, ends in t.SECTIONS}


def awards(spark: SparkSession, d: str) -> DataFrame:
    """Award texts with what most rules start from, each in a column of its own, so that it is computed once and only if it is used.

    clean (without boilerplate), a column for each section, decided (the
    decision, or the whole text of an award without one).
    """
    out = award_texts(spark, d).withColumn("clean", rules.without(the_text(), t.BOILERPLATE))
    out = out.select("*", *(rules.section(F.col("clean"), o, e).alias(n) for n, o, e in t.SECTIONS))
    return out.withColumn("decided", F.coalesce(F.nullif("decision", F.lit("")), the_text()))


def section(name: str) -> Column:
    return F.col(name)


@query("t04_remove_boilerplate", f"WITH {TEXTS} SELECT case_id, {_CLEAN} AS clean FROM texts")
def t04(spark: SparkSession, d: str) -> DataFrame:
    return awards(spark, d).select("case_id", "clean")


@query("t05_sections", f"WITH {TEXTS}, c AS (SELECT case_id, {_CLEAN} AS clean FROM texts) SELECT case_id, " + ", ".join(f"{_section('clean', o, e)} AS {n}" for n, o, e in t.SECTIONS) + f", regexp_extract(clean, {_lit('(?:依照|依据|根据)《[^》]+》[第0-9一二三四五六七八九十百千条款项、及\\s]+(?:之规定)?')}) AS legal FROM c")
def t05(spark: SparkSession, d: str) -> DataFrame:
    """The sections of an award; null where its heading is missing."""
    c = awards(spark, d)
    legal = F.regexp_extract("clean", "((?:依照|依据|根据)《[^》]+》[第0-9一二三四五六七八九十百千条款项、及\\s]+(?:之规定)?)", 1)
    return c.select("case_id", *_SECTION, legal.alias("legal"))


_ENTITIES = f"""nullif(regexp_extract(text, {_lit(t.CASE_NUMBER)}), '') AS case_number, nullif(regexp_extract(text, {_lit(t.COMMITTEE)}), '') AS committee,
 nullif(trim(regexp_extract(text, '申请人[：:\\s]*([^\\n，,。；;]{{2,40}})', 1)), '') AS applicant, nullif(trim(regexp_extract(text, '被申请人[：:\\s]*([^\\n，,。；;]{{2,40}})', 1)), '') AS respondent"""


def entities() -> list[Column]:
    text = the_text()
    party = lambda who: F.nullif(F.trim(F.regexp_extract(text, f"{who}[：:\\s]*([^\\n，,。；;]{{2,40}})", 1)), F.lit(""))
    return [rules.first_match(text, t.CASE_NUMBER).alias("case_number"), rules.first_match(text, t.COMMITTEE).alias("committee"), party("申请人").alias("applicant"), party("被申请人").alias("respondent")]


_ORDERED = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_PAID = f"list_filter(list_transform(regexp_extract_all(text, {_lit(t.PAID)}, 1), lambda v: v::DOUBLE), lambda v: v > 0 AND v < 100000000)"


@query("t07_entities", f"WITH {TEXTS} SELECT case_id, {_ENTITIES}, array_to_string({_ORDERED.format(x=f'regexp_extract_all(text, {_lit(t.DATES)})')}, ';') AS dates, list_sum({_ORDERED.format(x=_PAID)}) AS paid, len({_ORDERED.format(x=_PAID)}) AS n_paid FROM texts")
def t07(spark: SparkSession, d: str) -> DataFrame:
    """Case number, committee, parties, distinct dates and distinct amounts."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({t.DATES})"), F.lit(1)))
    paid = F.filter(F.transform(F.regexp_extract_all("text", F.lit(t.PAID), F.lit(1)), lambda v: v.cast("double")), lambda v: (v > 0) & (v < 100000000))
    total = F.when(F.size(F.array_distinct(paid)) > 0, F.aggregate(F.array_distinct(paid), F.lit(0.0), lambda a, v: a + v))
    return awards(spark, d).select("case_id", *entities(), F.array_join(found, ";").alias("dates"), total.alias("paid"), F.size(F.array_distinct(paid)).cast("long").alias("n_paid"))


_SPLIT_CLAIMS = "list_filter(list_transform(regexp_split_to_array({c}, '[1-9一二三四五六七八九十][、.：:]|\\n'), lambda x: trim(x, ' ' || chr(10) || chr(13) || chr(9))), lambda x: length(x) >= 4 AND NOT starts_with(x, '仲裁请求'))"
_ARTICLES = f"list_transform(range(1, len(regexp_extract_all(text, {_lit(t.ARTICLE)})) + 1), lambda i: '《' || trim(regexp_extract_all(text, {_lit(t.ARTICLE)}, 1)[i]) || '》第' || trim(regexp_extract_all(text, {_lit(t.ARTICLE)}, 2)[i]) || '条' || CASE WHEN regexp_extract_all(text, {_lit(t.ARTICLE)}, 3)[i] <> '' THEN '第' || regexp_extract_all(text, {_lit(t.ARTICLE)}, 3)[i] || '款' ELSE '' END || CASE WHEN regexp_extract_all(text, {_lit(t.ARTICLE)}, 4)[i] <> '' THEN '第' || regexp_extract_all(text, {_lit(t.ARTICLE)}, 4)[i] || '项' ELSE '' END)"


def split_claims(claims: Column) -> Column:
    """The single claims of a section, numbered or on lines of their own; those of four characters or more."""
    parts = F.transform(F.split(claims, "[1-9一二三四五六七八九十][、.：:]|\n"), lambda x: F.btrim(x, F.lit(" \n\r\t")))
    return F.filter(parts, lambda x: (F.length(x) >= 4) & ~F.startswith(x, F.lit("仲裁请求")))


def articles() -> Column:
    """Laws with the articles, paragraphs and items that a text names, distinct, in order."""
    text = the_text()
    part = lambda k: F.regexp_extract_all(text, F.lit(t.ARTICLE), F.lit(k))
    both = F.arrays_zip(part(1).alias("law"), part(2).alias("article"), part(3).alias("paragraph"), part(4).alias("item"))
    more = lambda x, mark: F.when(x != "", F.concat(F.lit("第"), x, F.lit(mark))).otherwise("")
    return F.array_distinct(F.transform(both, lambda x: F.concat(F.lit("《"), F.trim(x["law"]), F.lit("》第"), F.trim(x["article"]), F.lit("条"), more(x["paragraph"], "款"), more(x["item"], "项"))))


@query(
    "t08_structure",
    f"WITH {TEXTS}, c AS (SELECT case_id, {_CLEAN} AS text FROM texts), s AS (SELECT *, {_section('text', *_SECTION['claims'])} AS claims FROM c) SELECT case_id, {_ENTITIES}, array_to_string({_SPLIT_CLAIMS.format(c='claims')}, '|') AS claims, {_section('text', *_SECTION['facts'])} AS facts, {_section('text', *_SECTION['decision'])} AS decision, array_to_string({_ORDERED.format(x=_ARTICLES)}, '|') AS legal_basis FROM s",
)
def t08(spark: SparkSession, d: str) -> DataFrame:
    """An award's fields side by side, null where it lacks one."""
    c = awards(spark, d).withColumn("text", F.col("clean"))
    return c.select("case_id", *entities(), F.array_join(split_claims(section("claims")), "|").alias("claims"), "facts", "decision", F.array_join(articles(), "|").alias("legal_basis"))


def _token_sql() -> str:
    out = "r0 AS (SELECT case_id, regexp_replace(text, '[^一-龥a-zA-Z0-9]', ' ', 'g') AS r, CAST([] AS VARCHAR[]) AS w FROM texts)"
    for k, term in enumerate(t.LEGAL_TERMS):
        n = f"(length(r) - length(replace(r, {_lit(term)}, ''))) // {len(term)}"
        out += f", r{k + 1} AS (SELECT case_id, replace(r, {_lit(term)}, ' ') AS r, list_concat(w, list_transform(range({n}), lambda i: {_lit(t.SYNONYMS.get(term, term))})) AS w FROM r{k})"
    return out


_STOP, _LAST = _list(t.STOP_WORDS), len(t.LEGAL_TERMS)
_SYNONYM_SQL = "coalesce(map([" + ", ".join(map(_lit, t.SYNONYMS)) + "], [" + ", ".join(map(_lit, t.SYNONYMS.values())) + "])[{g}], {g})"


@query(
    "t09_tokens",
    f"""WITH {TEXTS}, {_token_sql()}, s AS (SELECT case_id, w, unnest(list_concat([''], list_filter(regexp_split_to_array(r, '\\s+'), lambda x: length(x) >= 2))) AS seg FROM r{_LAST}),
    g AS (SELECT case_id, unnest(CASE WHEN length(seg) <= 4 THEN [seg] ELSE list_concat(list_transform(range(1, length(seg)), lambda i: substring(seg, i, 2)), list_transform(range(1, length(seg) - 1), lambda i: substring(seg, i, 3))) END) AS g FROM s WHERE seg <> ''),
    k AS (SELECT unnest(w) AS token FROM r{_LAST} UNION ALL SELECT {_SYNONYM_SQL.format(g='g')} FROM g WHERE NOT list_contains({_STOP}, g)) SELECT token, count(*) AS n FROM k GROUP BY token""",
)
def t09(spark: SparkSession, d: str) -> DataFrame:
    counts = award_texts(spark, d, deal=True).select("text").mapInArrow(aw.count_tokens, "token string, n long")
    return counts.groupBy("token").agg(F.sum("n").alias("n"))


def _labels_sql(table: list[t.Rule], before: int, after: int, bonus: float) -> str:
    return f"""WITH {TEXTS}, m AS (SELECT case_id, text, name, weight, k, regexp_extract(text, pattern) AS m FROM texts, {_rule_table(table)}),
    g AS (SELECT case_id, any_value(text) AS text, name, any_value(weight) AS weight, count(*) AS n, arg_min(m, k) AS f, list_distinct(list(m)) AS w FROM m WHERE m <> '' GROUP BY case_id, name)
    SELECT case_id, name, array_to_string(list_sort(w), ';') AS words, {_around('text', 'f', before, after)} AS snippet, round(least(1.0, weight + CASE WHEN n > 1 THEN {bonus} ELSE 0 END), 2) AS confidence FROM g"""


def _labelled(spark: SparkSession, d: str, labels: Column) -> DataFrame:
    out = awards(spark, d).select("case_id", F.explode(labels).alias("x"))
    return out.select("case_id", "x.name", F.array_join(F.array_sort("x.words"), ";").alias("words"), "x.snippet", "x.confidence")


@query("t12_dispute_tags", _labels_sql(t.DISPUTES, 20, 30, 0.05))
def t12(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d, rules.labels(the_text(), t.DISPUTES, 20, 30, 0.05))


@query("t14_evidence", _labels_sql(t.EVIDENCE, 15, 25, 0))
def t14(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d, rules.labels(the_text(), t.EVIDENCE, 15, 25))


def _first_sql(table: list[t.Rule], first: str, least: int, wide: tuple[int, int], field: str, wide2: tuple[int, int], names: tuple[str, str]) -> str:
    return f"""a AS (SELECT case_id, name, weight AS confidence, {_lit(names[0])} AS source, arg_min(m, k) AS m, any_value(src) AS src FROM (SELECT case_id, name, weight, k, regexp_extract({first}, pattern) AS m, {first} AS src FROM s, {_rule_table(table)} WHERE length({first}) > {least}) WHERE m <> '' GROUP BY ALL),
    b AS (SELECT case_id, name, round(greatest(0.65, weight - 0.15), 2) AS confidence, {_lit(names[1])} AS source, arg_min(m, k) AS m, any_value(src) AS src FROM (SELECT case_id, name, weight, k, regexp_extract(text, pattern) AS m, text AS src FROM s, {_rule_table(table, field)}) WHERE m <> '' GROUP BY ALL)
    SELECT case_id, name, {_around('src', 'm', *wide)} AS snippet, confidence, source FROM a UNION ALL SELECT case_id, name, {_around('src', 'm', *wide2)}, confidence, source FROM b ANTI JOIN a USING (case_id, name)"""


@query("t13_defenses", f"WITH {TEXTS}, s AS (SELECT case_id, text, {_section(_CLEAN, *_SECTION['respondent'])} AS respondent FROM texts), " + _first_sql(t.DEFENSES, "respondent", 10, (15, 25), "context", (10, 25), ("respondent", "text")))
def t13(spark: SparkSession, d: str) -> DataFrame:
    """Defences by the patterns for the respondent's own section, else by those that name the respondent anywhere."""
    s = awards(spark, d).select("case_id", "text", section("respondent").alias("respondent"))
    found = rules.labels_first([(F.col("respondent"), "patterns", 0, "respondent"), (the_text(), "context", 0.15, "text")], t.DEFENSES, 10, 15, 25)
    return s.select("case_id", F.explode(found).alias("x")).select("case_id", "x.*")


@query("t15_loss_reasons", f"WITH {TEXTS}, s AS (SELECT case_id, text, coalesce({_section(_CLEAN, *_SECTION['reasoning'])}, '') || chr(10) || coalesce({_section(_CLEAN, *_SECTION['facts'])}, '') AS own FROM texts), " + _first_sql(t.LOSSES, "own", 20, (20, 40), "patterns", (20, 40), ("reasoning", "text")))
def t15(spark: SparkSession, d: str) -> DataFrame:
    """Reasons why a side lost, from reasoning and facts first, else from the whole text."""
    own = F.concat(F.coalesce(section("reasoning"), F.lit("")), F.lit("\n"), F.coalesce(section("facts"), F.lit("")))
    s = awards(spark, d).select("case_id", "text", own.alias("own"))
    found = rules.labels_first([(F.col("own"), "patterns", 0, "reasoning"), (the_text(), "patterns", 0.15, "text")], t.LOSSES, 20, 20, 40)
    return s.select("case_id", F.explode(found).alias("x")).select("case_id", "x.*")


_NUMBER = "'（([0-9]{4})）([0-9]+)号'"


@query("t16_base_info", f"WITH {TEXTS} SELECT case_id, regexp_extract(text, {_lit(t.COMMITTEE)}) || '与' || regexp_extract(text, '被申请人[：:]([^，。\\n]+)', 1) AS title, coalesce(nullif(regexp_extract(text, {_lit(t.COMMITTEE)}), ''), {_lit(t.DEFAULT_COMMITTEE)}) AS court, regexp_extract(text, {_NUMBER}, 1)::INTEGER AS year, CASE WHEN regexp_matches(text, '仲裁裁决书') THEN 'arbitration' WHEN contains(text, '民终') THEN 'second' WHEN contains(text, '民初') THEN 'first' ELSE 'unknown' END AS level, coalesce(filed::VARCHAR, regexp_extract(text, {_NUMBER}, 1) || '-01-01') AS date FROM texts")
def t16(spark: SparkSession, d: str) -> DataFrame:
    """Title, court, year, level and date, each from its own ladder of sources."""
    committee, year = rules.first_match(the_text(), t.COMMITTEE), rules.first_match(the_text(), "（([0-9]{4})）([0-9]+)号", 1)
    level = F.when(the_text().rlike("仲裁裁决书"), "arbitration").when(F.contains(the_text(), F.lit("民终")), "second").when(F.contains(the_text(), F.lit("民初")), "first").otherwise("unknown")
    title = F.concat(committee, F.lit("与"), F.regexp_extract("text", "被申请人[：:]([^，。\\n]+)", 1))
    return awards(spark, d).select("case_id", title.alias("title"), F.coalesce(committee, F.lit(t.DEFAULT_COMMITTEE)).alias("court"), year.cast("int").alias("year"), level.alias("level"), F.coalesce(F.col("filed").cast("string"), F.concat(year, F.lit("-01-01"))).alias("date"))


PARTY = "(被申请人|申请人|被上诉人|上诉人|原告|被告|第三人)[：:]([^，,。；;\\n（(]{2,40})"
_EMPLOYER = "公司|厂|企业|店|中心|医院|学校"


def parties() -> Column:
    """An array of (role, name, labor_role, confidence): who stands where; firms are employers, short personal names employees."""
    text = the_text()
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(PARTY), F.lit(1)).alias("role"), F.regexp_extract_all(text, F.lit(PARTY), F.lit(2)).alias("name"))

    def one(p: Column) -> Column:
        name = F.trim(p["name"])
        firm, person = name.rlike(_EMPLOYER), name.rlike("^[一-龥某×*]{2,4}$")
        return F.struct(p["role"].alias("role"), name.alias("name"), F.when(firm, "employer").when(person, "employee").otherwise("unknown").alias("labor_role"), F.when(firm, 0.9).when(person, 0.8).otherwise(0.3).alias("confidence"))

    return F.transform(both, one)


@query(
    "t17_parties",
    f"""WITH {TEXTS}, p AS (SELECT case_id, unnest(regexp_extract_all(text, {_lit(PARTY)}, 1)) AS role, trim(unnest(regexp_extract_all(text, {_lit(PARTY)}, 2))) AS name FROM texts)
    SELECT case_id, role, name, CASE WHEN regexp_matches(name, '{_EMPLOYER}') THEN 'employer' WHEN regexp_matches(name, '^[一-龥某×*]{{2,4}}$') THEN 'employee' ELSE 'unknown' END AS labor_role,
    CASE WHEN regexp_matches(name, '{_EMPLOYER}') THEN 0.9 WHEN regexp_matches(name, '^[一-龥某×*]{{2,4}}$') THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence FROM p""",
)
def t17(spark: SparkSession, d: str) -> DataFrame:
    return awards(spark, d).select("case_id", F.explode(parties()).alias("p")).select("case_id", "p.*")


def _without_sql(words: list[str]) -> str:
    out = "text"
    for w in words:
        out = f"replace({out}, {_lit(w)}, '')"
    return out


_TYPES = "list_filter([" + ", ".join(f"CASE WHEN {_any(_without_sql(t.MISLEADING.get(v, [])), words)} THEN {_lit(n)} END" for n, v, words in t.DISPUTE_TYPES) + "], lambda x: x IS NOT NULL)"


@query("t18_dispute_types", f"""WITH {TEXTS}, f AS (SELECT case_id, {_TYPES} AS x FROM texts), g AS (SELECT case_id, CASE WHEN list_contains(x, '违法解除赔偿金') AND NOT list_contains(x, '劳动合同解除') THEN list_concat(x, ['劳动合同解除']) ELSE x END AS x FROM f)
    SELECT case_id, unnest(CASE WHEN len(x) > 0 THEN x ELSE ['劳动争议综合'] END) AS type FROM g""")
def t18(spark: SparkSession, d: str) -> DataFrame:
    """Dispute types; misleading phrases are taken out before some of them are looked for."""
    def target(variant: str) -> Column:
        out = the_text()
        for w in t.MISLEADING.get(variant, []):
            out = F.replace(out, F.lit(w), F.lit(""))
        return out

    found = F.array_compact(F.array(*(F.when(rules.has_any(target(v), words), F.lit(n)) for n, v, words in t.DISPUTE_TYPES)))
    more = rules.let(found, lambda x: F.when(F.array_contains(x, "违法解除赔偿金"), F.array_union(x, F.array(F.lit("劳动合同解除")))).when(F.size(x) > 0, x).otherwise(F.array(F.lit("劳动争议综合"))))
    return awards(spark, d).select("case_id", F.explode(more).alias("type"))


@query("t19_court_sections", f"WITH {TEXTS}, j AS (SELECT case_id, replace(replace(text, '本委认为', '本院认为'), '裁决如下', '判决如下') AS text FROM texts) SELECT case_id, " + ", ".join(f"{_section('text', o, e, c)} AS {n}" for n, o, e, c in t.COURT_SECTIONS) + " FROM j")
def t19(spark: SparkSession, d: str) -> DataFrame:
    """Sections of court judgments, some of them clipped."""
    j = awards(spark, d).select("case_id", F.replace(F.replace(the_text(), F.lit("本委认为"), F.lit("本院认为")), F.lit("裁决如下"), F.lit("判决如下")).alias("text"))
    return j.select("case_id", *(rules.section(the_text(), o, e, c).alias(n) for n, o, e, c in t.COURT_SECTIONS))


AMOUNT = "(?:人民币\\s*)?([0-9][0-9,]*(?:\\.\\d+)?)\\s*元"


def _claims_sql() -> str:
    out = f"c0 AS (SELECT case_id, {_section(_CLEAN, *_SECTION['claims'])} AS r, {_section(_CLEAN, *_SECTION['claims'])} AS src, {_section(_CLEAN, *_SECTION['decision'])} AS decision, CAST([] AS VARCHAR[]) AS w FROM texts)"
    for k, (name, _, words) in enumerate(t.CLAIMS):
        gone = "coalesce(r, '')"
        for x in words:
            gone = f"replace({gone}, {_lit(x)}, ' ')"
        out += f", c{k + 1} AS (SELECT case_id, {gone} AS r, src, decision, CASE WHEN {_any('r', words)} THEN list_concat(w, [{_lit(name)}]) ELSE w END AS w FROM c{k})"
    return out


_CLAIM_TABLE = "(VALUES " + ", ".join(f"({_lit(n)}, {_lit(k)}, {_list(words)})" for n, k, words in t.CLAIMS) + ") AS k(name, type, words)"


def claims_of(claims: Column, decision: Column) -> Column:
    """An array of claims with type, amounts asked and awarded, and outcome.

    Claims are looked for in order, and the words of each are taken out before the
    next, so a short name inside a longer one is no second claim.  An amount is
    the first within 48 characters after the claim's words; a claim that the
    decision names with an order has its outcome, all others are unclear.
    """
    found = rules.taken_in_turn(F.coalesce(claims, F.lit("")), [(n, list(words)) for n, _, words in t.CLAIMS])["found"]
    known = {n: (k, words) for n, k, words in t.CLAIMS}
    types = F.create_map(*(F.lit(x) for n, (k, _) in known.items() for x in (n, k)))
    words = F.create_map(*(x for n, (_, w) in known.items() for x in (F.lit(n), F.array(*map(F.lit, w)))))

    def near(text: Column, ws: Column) -> Column:
        at = F.array_sort(F.filter(F.transform(ws, lambda w: F.struct(F.position(w, text).alias("i"), (-F.length(w)).alias("n"))), lambda x: x["i"] > 0))
        amounts = F.transform(at, lambda x: F.replace(F.regexp_extract(F.substring(text, x["i"], 48 - x["n"]), AMOUNT, 1), F.lit(","), F.lit("")).try_cast("double"))
        return F.get(F.filter(amounts, lambda a: a.isNotNull()), F.lit(0))

    def one(c: Column) -> Column:
        ws, kind = words[c["name"]], types[c["name"]]
        clauses = F.filter(F.split(F.coalesce(decision, F.lit("")), "[。；;，,\n\r]+"), lambda s: F.exists(ws, lambda w: F.contains(s, w)))
        orders = F.transform(clauses, lambda s: rules.first_name(s, t.ACTIONS, F.lit("unclear")))
        return F.struct(c["name"].alias("name"), kind.alias("type"), near(claims, ws).alias("asked"), near(F.coalesce(decision, F.lit("")), ws).alias("awarded"), orders.alias("orders"))

    def judged(c: Column) -> Column:
        support, reject = F.exists(c["orders"], lambda o: o.isin("support", "pay")), F.array_contains(c["orders"], "reject")
        by_amount = F.when((c["asked"] > 0) & (c["awarded"] >= 0), F.when(c["awarded"] == 0, "not_supported").when(c["awarded"] < c["asked"], "partially_supported").otherwise("supported"))
        outcome = F.when(reject & ~support, "not_supported").when(reject & support, "partially_supported").when(support, F.coalesce(by_amount, F.lit("supported"))).otherwise("unclear")
        return F.struct(c["name"].alias("name"), c["type"].alias("type"), c["asked"].alias("asked"), F.when(support, c["awarded"]).alias("awarded"), outcome.alias("outcome"))

    return F.transform(F.transform(found, one), judged)


def _near_sql(text: str) -> str:
    """First amount after the claim's words, the earliest and longest word first."""
    order = f"list_sort(list_filter(list_transform(words, lambda w: {{'i': strpos({text}, w), 'n': -length(w)}}), lambda x: x.i > 0))"
    return f"list_filter(list_transform({order}, lambda x: TRY_CAST(replace(regexp_extract(substring({text}, x.i, 48 - x.n), {_lit(AMOUNT)}, 1), ',', '') AS DOUBLE)), lambda a: a IS NOT NULL)[1]"


def _action_sql(s: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({s}, {_lit(p)}) THEN {_lit(n)}" for n, p in t.ACTIONS) + " ELSE 'unclear' END"


_CLAIM_ROWS = f"""{_claims_sql()}, n AS (SELECT case_id, src, coalesce(decision, '') AS decision, unnest(w) AS name FROM c{len(t.CLAIMS)}), q AS (SELECT n.*, k.type, {_near_sql('src')} AS asked, {_near_sql('decision')} AS awarded,
    list_transform(list_filter(regexp_split_to_array(decision, '[。；;，,\\n\\r]+'), lambda s: len(list_filter(words, lambda w: contains(s, w))) > 0), lambda s: {_action_sql('s')}) AS orders FROM n JOIN {_CLAIM_TABLE} USING (name)),
    claims AS (SELECT case_id, name, type, asked, CASE WHEN list_has_any(orders, ['support', 'pay']) THEN awarded END AS awarded, CASE WHEN list_has_any(orders, ['support', 'pay']) THEN CASE WHEN list_contains(orders, 'reject') THEN 'partially_supported' WHEN asked > 0 AND awarded >= 0 THEN CASE WHEN awarded = 0 THEN 'not_supported' WHEN awarded < asked THEN 'partially_supported' ELSE 'supported' END ELSE 'supported' END WHEN list_contains(orders, 'reject') THEN 'not_supported' ELSE 'unclear' END AS outcome FROM q)"""


def claim_rows(spark: SparkSession, d: str) -> DataFrame:
    """case_id, name, type, asked, awarded, outcome of each claim."""
    s = awards(spark, d).select("case_id", section("claims").alias("claims"), section("decision").alias("decision"))
    return s.select("case_id", F.explode(claims_of(F.col("claims"), F.col("decision"))).alias("c")).select("case_id", "c.*")


@query("t20_claims", f"WITH {TEXTS}, {_CLAIM_ROWS} SELECT * FROM claims")
def t20(spark: SparkSession, d: str) -> DataFrame:
    return claim_rows(spark, d)


def clauses(decision: Column) -> Column:
    """An array of (pos, source, action, target, awarded): a decision's clauses that order something."""
    parts = F.filter(F.transform(F.split(decision, "[。；;，,\n\r]+"), lambda x: F.trim(x)), lambda x: x != "")

    def one(s: Column, i: Column) -> Column:
        action = rules.first_name(s, t.ACTIONS, F.lit("unclear"))
        first = F.replace(F.regexp_extract(s, AMOUNT, 1), F.lit(","), F.lit("")).try_cast("double")
        return F.struct(i.alias("pos"), s.alias("source"), action.alias("action"), rules.first_name(s, t.TARGETS, F.lit("unknown")).alias("target"), F.when(action == "reject", F.lit(0.0)).when(action == "pay", first).alias("awarded"))

    return F.filter(F.transform(parts, one), lambda c: c["action"] != "unclear")


_TARGET = "CASE " + " ".join(f"WHEN regexp_matches(source, {_lit(p)}) THEN {_lit(n)}" for n, p in t.TARGETS) + " ELSE 'unknown' END"
_CLAUSES = f"""d AS (SELECT case_id, list_filter(list_transform(regexp_split_to_array({_section(_CLEAN, *_SECTION['decision'])}, '[。；;，,\\n\\r]+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM texts),
    e AS (SELECT case_id, unnest(p) AS source, unnest(range(len(p)))::INTEGER AS pos FROM d), clauses AS (SELECT * FROM (SELECT case_id, pos, source, {_action_sql('source')} AS action, {_TARGET} AS target FROM e) WHERE action <> 'unclear')"""
_AWARDED = f"CASE action WHEN 'reject' THEN 0.0 WHEN 'pay' THEN TRY_CAST(replace(regexp_extract(source, {_lit(AMOUNT)}, 1), ',', '') AS DOUBLE) END::DOUBLE"


@query("t21_judgment_actions", f"WITH {TEXTS}, {_CLAUSES} SELECT *, {_AWARDED} AS awarded FROM clauses")
def t21(spark: SparkSession, d: str) -> DataFrame:
    return awards(spark, d).select("case_id", F.explode(clauses(section("decision"))).alias("c")).select("case_id", "c.*")


@query("t22_claim_types", f"WITH {TEXTS}, {_CLAIM_ROWS} SELECT type, count(*) AS n, sum(CASE WHEN asked IS NULL THEN 0 ELSE 1 END)::BIGINT AS with_amount FROM claims GROUP BY type")
def t22(spark: SparkSession, d: str) -> DataFrame:
    return claim_rows(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.count("asked").alias("with_amount"))


REFERENCE = "上述|前述|该项请求|第[一二三四五六七八九十]+项|其余请求"


@query("t23_unresolved_references", f"WITH {TEXTS} SELECT case_id, unnest(list_filter(list_transform(regexp_split_to_array({_section(_CLEAN, *_SECTION['decision'])}, '[。；;\\n\\r]+'), lambda x: trim(x)), lambda x: regexp_matches(x, '{REFERENCE}'))) AS source FROM texts")
def t23(spark: SparkSession, d: str) -> DataFrame:
    """Clauses that point at claims by number or by what was said before."""
    parts = F.filter(F.transform(F.split(section("decision"), "[。；;\n\r]+"), lambda x: F.trim(x)), lambda x: x.rlike(REFERENCE))
    return awards(spark, d).select("case_id", F.explode(parts).alias("source"))


_PART = "([^，。；\\n]*?(?:{p})[^，。；\\n]*)"


@query(
    "t24_defense_catalogue",
    f"""WITH {TEXTS}, s AS (SELECT case_id, text, {_section(_CLEAN, *_SECTION['respondent'])} AS r, {_section(_CLEAN, *_SECTION['reasoning'])} AS j FROM texts), k AS (SELECT * FROM (VALUES {", ".join(f"({_lit(n)}, {_list(w)}, {_lit(_PART.format(p=p))})" for n, w, p in t.DEFENSE_KINDS)}) AS k(name, words, part)),
    h AS (SELECT case_id, name, words, nullif(trim(regexp_extract(r, part)), '') AS a, nullif(trim(regexp_extract(j, part)), '') AS b FROM s, k WHERE len(list_filter(words, lambda w: contains(text, w))) > 0)
    SELECT case_id, name, coalesce(a, b, words[1]) AS matched, CASE WHEN a IS NOT NULL THEN 0.9 WHEN b IS NOT NULL THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM h""",
)
def t24(spark: SparkSession, d: str) -> DataFrame:
    """Defences with the sentence part that names them: best in the respondent's section, then in the reasoning."""
    s = awards(spark, d).select("case_id", "text", section("respondent").alias("r"), section("reasoning").alias("j"))

    def one(name: str, words: str, part: str) -> Column:
        a, b = (F.nullif(F.trim(F.regexp_extract(c, _PART.format(p=part), 1)), F.lit("")) for c in ("r", "j"))
        return F.when(rules.has_any(the_text(), words), F.struct(F.lit(name).alias("name"), F.coalesce(a, b, F.lit(words[0])).alias("matched"), F.when(a.isNotNull(), 0.9).when(b.isNotNull(), 0.8).otherwise(0.6).alias("confidence")))

    return s.select("case_id", F.explode(F.array_compact(F.array(*(one(*k) for k in t.DEFENSE_KINDS)))).alias("x")).select("case_id", "x.*")


@query(
    "t25_evidence_providers",
    f"""WITH {TEXTS}, k AS (SELECT * FROM (VALUES {", ".join(f"({_lit(n)}, {_list(w)}, {_lit(_PART.format(p=p))})" for n, w, p in t.EVIDENCE_KINDS)}) AS k(name, words, part)),
    h AS (SELECT case_id, name, text, words, part, list_filter(list_transform(regexp_split_to_array(text, '[。；\\n]'), lambda s: trim(s)), lambda s: len(list_filter(words, lambda w: contains(s, w))) > 0 AND regexp_matches(s, '{t.HANDED_IN}'))[1] AS s FROM texts, k WHERE len(list_filter(words, lambda w: contains(text, w))) > 0),
    p AS (SELECT *, regexp_extract(s, '^(.*?)(?:{t.HANDED_IN})', 1) AS before FROM h),
    v AS (SELECT *, CASE WHEN s IS NULL OR regexp_matches(before, '(未|没|没有|未能)$') THEN 'unknown' WHEN regexp_matches(before, '第三方|第三人') THEN 'third_party' WHEN regexp_matches(before, '(本院|法院)(依法)?$') THEN 'court' WHEN contains(before, '被申请人') THEN 'employer' WHEN contains(before, '申请人') THEN 'employee' ELSE 'unknown' END AS provider FROM p)
    SELECT case_id, name, provider, CASE WHEN provider <> 'unknown' THEN s ELSE coalesce(nullif(trim(regexp_extract(text, part)), ''), words[1]) END AS matched, CASE WHEN provider <> 'unknown' THEN 0.9 WHEN regexp_extract(text, part) <> '' THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM v""",
)
def t25(spark: SparkSession, d: str) -> DataFrame:
    """Evidence with who handed it in: the actor before the first verb, unless that is denied."""
    return award_texts(spark, d, deal=True).select("case_id", "text").mapInArrow(aw.all_evidence, aw.EVIDENCE)


@query("t26_key_points", f"WITH {TEXTS}, r AS (SELECT case_id, coalesce({_section(_CLEAN, *_SECTION['reasoning'])}, '') AS j FROM texts), p AS (SELECT case_id, list_filter([" + ", ".join(f"CASE WHEN {' AND '.join(_any('j', g) for g in groups)} THEN {_lit(n)} END" for n, groups in t.KEY_POINTS) + f"], lambda x: x IS NOT NULL) AS p FROM r) SELECT case_id, unnest(CASE WHEN len(p) > 0 THEN p ELSE [{_lit(t.NO_KEY_POINT)}] END) AS point FROM p")
def t26(spark: SparkSession, d: str) -> DataFrame:
    j = F.coalesce(section("reasoning"), F.lit(""))

    def all_of(groups: list[str]) -> Column:
        out = rules.has_any(j, groups[0])
        for g in groups[1:]:
            out = out & rules.has_any(j, g)
        return out

    found = F.array_compact(F.array(*(F.when(all_of(groups), F.lit(n)) for n, groups in t.KEY_POINTS)))
    return awards(spark, d).select("case_id", F.explode(rules.let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(t.NO_KEY_POINT))))).alias("point"))


@query(
    "t27_outcome_diagnostics",
    f"""WITH {TEXTS}, {_CLAIM_ROWS}, {_CLAUSES}, a AS (SELECT case_id, count(*) AS actions FROM clauses GROUP BY case_id)
    SELECT case_id, name, outcome, CASE WHEN outcome <> 'unclear' THEN 'RESOLVED' WHEN coalesce(actions, 0) = 0 THEN 'NO_JUDGMENT_ACTION' WHEN asked IS NULL THEN 'NO_REQUESTED_AMOUNT' ELSE 'NO_MATCHING_ACTION' END AS reason, outcome = 'unclear' AS needs_review FROM claims LEFT JOIN a USING (case_id)""",
)
def t27(spark: SparkSession, d: str) -> DataFrame:
    """Why a claim's outcome is known or not: a ladder of reasons."""
    texts = awards(spark, d).select("case_id", section("claims").alias("claims"), section("decision").alias("decision"))
    rows = texts.select("case_id", F.size(clauses(F.col("decision"))).alias("actions"), F.explode(claims_of(F.col("claims"), F.col("decision"))).alias("c"))
    reason = F.when(F.col("c.outcome") != "unclear", "RESOLVED").when(F.coalesce("actions", F.lit(0)) <= 0, "NO_JUDGMENT_ACTION").when(F.col("c.asked").isNull(), "NO_REQUESTED_AMOUNT").otherwise("NO_MATCHING_ACTION")
    return rows.select("case_id", "c.name", "c.outcome", reason.alias("reason"), (F.col("c.outcome") == "unclear").alias("needs_review"))


_MERGED = "CASE WHEN bool_or(outcome = 'partially_supported') OR (bool_or(outcome = 'supported') AND bool_or(outcome = 'not_supported')) THEN 'partially_supported' WHEN bool_or(outcome = 'supported') THEN 'supported' WHEN bool_or(outcome = 'not_supported') THEN 'not_supported' ELSE 'unclear' END"
_ROLE = "CASE WHEN regexp_matches(regexp_extract(text, '申请人[：:]([^，。\\n]+)', 1), '公司|厂|企业') THEN 'employer' ELSE 'employee' END"


def party_outcomes(role: Column, applicant: Column) -> list[Column]:
    """What an applicant's outcome means for the employee and for the employer."""
    other = F.when(applicant == "supported", "not_supported").when(applicant == "not_supported", "supported").otherwise(applicant)
    unknown = (role == "unknown") | (applicant == "unclear")
    side = lambda own: F.when(unknown, "unclear").when(role == own, applicant).otherwise(other)
    return [side("employee").alias("employee"), side("employer").alias("employer")]


@query("t28_party_outcomes", f"WITH {TEXTS}, {_CLAIM_ROWS}, o AS (SELECT case_id, {_MERGED} AS applicant FROM claims GROUP BY case_id), r AS (SELECT case_id, {_ROLE} AS role FROM texts) SELECT case_id, role, coalesce(applicant, 'unclear') AS applicant, CASE WHEN coalesce(applicant, 'unclear') = 'unclear' THEN 'unclear' WHEN role = 'employee' OR applicant = 'partially_supported' THEN applicant WHEN applicant = 'supported' THEN 'not_supported' ELSE 'supported' END AS employee, CASE WHEN coalesce(applicant, 'unclear') = 'unclear' THEN 'unclear' WHEN role = 'employer' OR applicant = 'partially_supported' THEN applicant WHEN applicant = 'supported' THEN 'not_supported' ELSE 'supported' END AS employer FROM r LEFT JOIN o USING (case_id)")
def t28(spark: SparkSession, d: str) -> DataFrame:
    """The outcome of both sides from an award's claims, in the row: no shuffle."""
    from verdigris.functions.rates import merged_outcome

    found = awards(spark, d).select("case_id", "text", claims_of(section("claims"), section("decision")).alias("found"))
    s = found.select("case_id", applicant_role().alias("role"), merged_outcome(F.transform("found", lambda c: c["outcome"])).alias("applicant"))
    return s.select("case_id", "role", "applicant", *party_outcomes(F.col("role"), F.col("applicant")))


def applicant_role() -> Column:
    return F.when(F.regexp_extract(the_text(), "申请人[：:]([^，。\\n]+)", 1).rlike("公司|厂|企业"), "employer").otherwise("employee")


@query("t29_outcome_complement", "WITH r AS (SELECT unnest(['employee', 'employer', 'unknown']) AS role), o AS (SELECT unnest(['supported', 'partially_supported', 'not_supported', 'unclear']) AS applicant) SELECT role, applicant, CASE WHEN role = 'unknown' OR applicant = 'unclear' THEN 'unclear' WHEN applicant = 'partially_supported' OR role = 'employee' THEN applicant WHEN applicant = 'supported' THEN 'not_supported' ELSE 'supported' END AS employee, CASE WHEN role = 'unknown' OR applicant = 'unclear' THEN 'unclear' WHEN applicant = 'partially_supported' OR role = 'employer' THEN applicant WHEN applicant = 'supported' THEN 'not_supported' ELSE 'supported' END AS employer FROM r, o")
def t29(spark: SparkSession, d: str) -> DataFrame:
    """The whole table of roles and outcomes."""
    rows = [(r, o) for r in ("employee", "employer", "unknown") for o in ("supported", "partially_supported", "not_supported", "unclear")]
    return spark.createDataFrame(rows, "role string, applicant string").select("role", "applicant", *party_outcomes(F.col("role"), F.col("applicant")))


_DECIDED = f"coalesce(nullif({_section(_CLEAN, *_SECTION['decision'])}, ''), text)"


def _award_outcome_sql() -> str:
    d = "dec"
    reject = f"(contains({d}, '驳回申请人的全部仲裁请求') OR contains({d}, '驳回申请人的仲裁请求') OR contains({d}, '驳回申请人全部仲裁请求'))"
    pay = f"({' OR '.join(f'contains({d}, {_lit(w)})' for w in ('支付', '连带责任', '确认劳动关系', '赔偿金', '补偿金'))})"
    return f"CASE WHEN {' OR '.join(f'contains({d}, {_lit(w)})' for w in ('调解协议', '达成调解', '撤回仲裁申请'))} THEN '调解/其他' WHEN {reject} AND NOT {pay} THEN '用人单位胜诉' WHEN contains({d}, '驳回申请人的其他仲裁请求') AND {pay} THEN '部分支持' WHEN {pay} THEN '用人单位败诉' ELSE '部分支持' END"


def award_outcome(decision: Column) -> Column:
    """The tendency of an award's decision, in the four legacy classes."""
    reject, pay = rules.has_any(decision, "驳回申请人的全部仲裁请求 驳回申请人的仲裁请求 驳回申请人全部仲裁请求"), rules.has_any(decision, "支付 连带责任 确认劳动关系 赔偿金 补偿金")
    settled = rules.has_any(decision, "调解协议 达成调解 撤回仲裁申请")
    return F.when(settled, "调解/其他").when(reject & ~pay, "用人单位胜诉").when(F.contains(decision, F.lit("驳回申请人的其他仲裁请求")) & pay, "部分支持").when(pay, "用人单位败诉").otherwise("部分支持")


@query("t30_arbitration_parser", f"WITH {TEXTS}, s AS (SELECT *, {_DECIDED} AS dec FROM texts) SELECT case_id, {_ENTITIES.replace(chr(10), ' ')}, len({_SPLIT_CLAIMS.format(c='(' + _section(_CLEAN, *_SECTION['claims']) + ')')}) AS n_claims, {_award_outcome_sql()} AS outcome, {_section(_CLEAN, *_SECTION['reasoning'])} AS reasoning FROM s")
def t30(spark: SparkSession, d: str) -> DataFrame:
    """An award as a record: number, committee, parties, number of claims, outcome, reasoning."""
    decided = F.col("decided")
    return awards(spark, d).select("case_id", *entities(), F.size(split_claims(section("claims"))).cast("long").alias("n_claims"), award_outcome(decided).alias("outcome"), section("reasoning").alias("reasoning"))


_LAW = "(?:" + "|".join(t.LAWS) + ")第[一二三四五六七八九十百0-9、及]+条"


@query("t31_award_helpers", f"WITH {TEXTS}, s AS (SELECT *, {_DECIDED} AS dec FROM texts), g AS (SELECT *, {_names('text', t.AWARD_TAGS)} AS tags FROM s) SELECT case_id, array_to_string({_ORDERED.format(x=f'regexp_extract_all(text, {_lit(_LAW)})')}, '|') AS laws, array_to_string(CASE WHEN len(tags) > 0 THEN tags ELSE ['劳动报酬争议'] END, '|') AS tags, {_award_outcome_sql()} AS outcome, regexp_replace(regexp_extract(text, '深[一-龥]{{0,6}}劳人仲[案裁字]?[（(\\[]?\\s*[0-9]{{4}}\\s*[)）\\]]?[0-9]+号'), '\\s+', '', 'g') AS number FROM g")
def t31(spark: SparkSession, d: str) -> DataFrame:
    """Laws named, tags by key words, outcome and number of an award."""
    laws = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({_LAW})"), F.lit(1)))
    number = F.regexp_replace(F.regexp_extract("text", "(深[一-龥]{0,6}劳人仲[案裁字]?[（(\\[]?\\s*[0-9]{4}\\s*[)）\\]]?[0-9]+号)", 1), "\\s+", "")
    decided = F.col("decided")
    return awards(spark, d).select("case_id", F.array_join(laws, "|").alias("laws"), F.array_join(rules.names_of(the_text(), t.AWARD_TAGS, "劳动报酬争议"), "|").alias("tags"), award_outcome(decided).alias("outcome"), number.alias("number"))


COURTS = ["广东省广州市天河区人民法院", "江门市新会区人民法院", "浙江省余姚市人民法院", "北京第一中级人民法院", "", "某法院"]
_NUMBERS = ["（2020）粤03民初12号", "（2021）粤19民终7号", "(2022)沪01民初5号", "（2020）浙02 民初9号", "无"]
CODE = "[（(〔\\[]\\s*\\d{4}\\s*[)）〕\\]]\\s*([一-龥]{1,4}\\d{0,2})"
MUNICIPALITIES = ["北京", "上海", "天津", "重庆"]


def city_of(court: Column, number: Column) -> Column:
    """(city, source, confidence): by the court's name, else by the code in the case number."""
    province = F.nullif(F.regexp_extract(court, "^([一-龥]{2,4}?(?:省|自治区|特别行政区))", 1), F.lit(""))
    rest = F.when(province.isNotNull(), F.replace(court, province, F.lit(""))).otherwise(court)
    central = F.coalesce(*(F.when(F.startswith(court, F.lit(m)), F.lit(m)) for m in MUNICIPALITIES))
    by_court = F.coalesce(central, F.regexp_replace(F.nullif(F.regexp_extract(rest, "^([一-龥]{2,6}?)市", 1), F.lit("")), "中级|基层|高级", ""))
    code = F.regexp_extract(number, CODE, 1)
    by_code = F.coalesce(*(F.when(F.startswith(code, F.lit(k)), F.lit(v)) for k, v in t.COURT_CODES))
    return F.struct(F.coalesce(by_court, by_code).alias("city"), F.when(by_court.isNotNull(), "court").when(by_code.isNotNull(), "number").otherwise("unknown").alias("source"), F.when(by_court.isNotNull(), 0.9).when(by_code.isNotNull(), 0.7).otherwise(0.0).alias("confidence"))


_CODES = "(VALUES " + ", ".join(f"({_lit(k)}, {_lit(v)}, {i})" for i, (k, v) in enumerate(t.COURT_CODES)) + ") AS k(code, name, i)"


@query(
    "t32_city",
    f"""WITH s AS (SELECT o_orderkey AS case_id, {_list(COURTS)}[1 + o_orderkey % {len(COURTS)}] AS court, {_list(_NUMBERS)}[1 + (o_orderkey // 3) % {len(_NUMBERS)}] AS number FROM orders), p AS (SELECT *, nullif(regexp_extract(court, '^([一-龥]{{2,4}}?(?:省|自治区|特别行政区))', 1), '') AS province FROM s),
    b AS (SELECT *, coalesce(CASE WHEN starts_with(court, '北京') THEN '北京' WHEN starts_with(court, '上海') THEN '上海' WHEN starts_with(court, '天津') THEN '天津' WHEN starts_with(court, '重庆') THEN '重庆' END, nullif(regexp_extract(CASE WHEN province IS NULL THEN court ELSE replace(court, province, '') END, '^([一-龥]{{2,6}}?)市', 1), '')) AS by_court,
    (SELECT arg_min(name, i) FROM {_CODES} WHERE starts_with(regexp_extract(number, {_lit(CODE)}, 1), code)) AS by_code FROM p)
    SELECT case_id, coalesce(by_court, by_code) AS city, CASE WHEN by_court IS NOT NULL THEN 'court' WHEN by_code IS NOT NULL THEN 'number' ELSE 'unknown' END AS source, CASE WHEN by_court IS NOT NULL THEN 0.9 WHEN by_code IS NOT NULL THEN 0.7 ELSE 0 END::DOUBLE AS confidence FROM b""",
)
def t32(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda options, step: F.get(F.array(*map(F.lit, options)), (F.floor(F.col("case_id") / step) % len(options)).cast("int"))
    s = awards(spark, d).select("case_id", pick(COURTS, 1).alias("court"), pick(_NUMBERS, 3).alias("number"))
    return s.select("case_id", city_of(F.col("court"), F.col("number")).alias("x")).select("case_id", "x.*")


ORDINALS = "一二三四五六七八九十"


@query(
    "t33_ordinal_references",
    f"WITH {TEXTS}, s AS (SELECT case_id, unnest(list_filter(regexp_split_to_array(text, '[。；;，,\\n\\r]+'), lambda x: regexp_matches(x, '第[{ORDINALS}]+项|前[{ORDINALS}]项|其余(?:各项)?请求'))) AS source FROM texts) SELECT case_id, source, strpos('{ORDINALS}', nullif(regexp_extract(source, '第([{ORDINALS}])项', 1), ''))::INTEGER AS ordinal, strpos('{ORDINALS}', nullif(regexp_extract(source, '前([{ORDINALS}])项', 1), ''))::INTEGER AS first_n, regexp_matches(source, '其余(?:各项)?请求') AS rest, {_action_sql('source')} AS treatment FROM s",
)
def t33(spark: SparkSession, d: str) -> DataFrame:
    """Clauses that name claims by their number, the first so many, or all others, and how they treat them."""
    parts = F.filter(F.split(the_text(), "[。；;，,\n\r]+"), lambda x: x.rlike(f"第[{ORDINALS}]+项|前[{ORDINALS}]项|其余(?:各项)?请求"))
    s = awards(spark, d).select("case_id", F.explode(parts).alias("source"))
    number = lambda mark: F.position(F.nullif(F.regexp_extract("source", f"{mark}([{ORDINALS}])项", 1), F.lit("")), F.lit(ORDINALS))
    return s.select("case_id", "source", number("第").alias("ordinal"), number("前").alias("first_n"), F.col("source").rlike("其余(?:各项)?请求").alias("rest"), rules.first_name(F.col("source"), t.ACTIONS, F.lit("unclear")).alias("treatment"))


@query("t34_claim_outcome", f"WITH {TEXTS}, {_CLAIM_ROWS} SELECT name, outcome, count(*) AS n, sum(awarded::DECIMAL(18, 2))::DOUBLE AS awarded FROM claims GROUP BY name, outcome")
def t34(spark: SparkSession, d: str) -> DataFrame:
    """Claims by the outcome that their orders and amounts give."""
    return claim_rows(spark, d).groupBy("name", "outcome").agg(F.count("*").alias("n"), F.sum(F.col("awarded").cast("decimal(18,2)")).cast("double").alias("awarded"))


@query("t36_page_tags", f"WITH {TEXTS}, g AS (SELECT case_id, list_concat({_names('text', [(c, c) for c in t.PAGE_CITIES])}, {_names('text', t.PAGE_TAGS)}) AS x FROM texts) SELECT case_id, unnest(CASE WHEN len(x) > 0 THEN x ELSE ['劳动争议'] END) AS tag FROM g")
def t36(spark: SparkSession, d: str) -> DataFrame:
    return awards(spark, d).select("case_id", F.explode(rules.names_of(the_text(), [(c, c) for c in t.PAGE_CITIES] + t.PAGE_TAGS, "劳动争议")).alias("tag"))


@query("t38_evidence_names", f"WITH {TEXTS}, m AS (SELECT regexp_extract(text, pattern) AS word FROM texts, {_rule_table(t.EVIDENCE)}), n AS (SELECT CASE " + " ".join(f"WHEN regexp_matches(word, {_lit(p)}) THEN {_lit(n)}" for n, p in t.EVIDENCE_NAMES) + " ELSE trim(word) END AS name FROM m WHERE word <> '') SELECT name, count(*) AS n FROM n GROUP BY name")
def t38(spark: SparkSession, d: str) -> DataFrame:
    """Evidence under common names."""
    words = F.array_compact(F.array(*(rules.first_match(the_text(), r.patterns[0]) for r in t.EVIDENCE)))
    found = awards(spark, d).select(F.explode(words).alias("word"))
    return found.groupBy(rules.first_name(F.col("word"), t.EVIDENCE_NAMES, F.trim("word")).alias("name")).agg(F.count("*").alias("n"))


_DATE = "'([0-9]{4})[-/年.]([0-9]{1,2})[-/月.]([0-9]{1,2})'"


@query("m01_calendar_dates", f"WITH {TEXTS} SELECT case_id, CASE WHEN year(TRY_CAST(regexp_extract(text, {_DATE}, 1) || '-' || lpad(regexp_extract(text, {_DATE}, 2), 2, '0') || '-' || lpad(regexp_extract(text, {_DATE}, 3), 2, '0') AS DATE)) BETWEEN 1900 AND 2100 THEN TRY_CAST(regexp_extract(text, {_DATE}, 1) || '-' || lpad(regexp_extract(text, {_DATE}, 2), 2, '0') || '-' || lpad(regexp_extract(text, {_DATE}, 3), 2, '0') AS DATE) END::VARCHAR AS date FROM texts")
def m01(spark: SparkSession, d: str) -> DataFrame:
    return awards(spark, d).select("case_id", dates.calendar_date(the_text()).cast("string").alias("date"))


_HAN = ["二〇二三年八月十五日", "二〇二一年十月三十一日", "二〇二二年十二月九日", "2020年2月3日", "二〇一九年二十月三日", "无日期"]


@query("m02_chinese_dates", f"SELECT o_orderkey AS case_id, {_list(['2023-08-15', '2021-10-31', '2022-12-09', '2020-02-03', '', ''])}[1 + o_orderkey % {len(_HAN)}] AS date FROM orders")
def m02(spark: SparkSession, d: str) -> DataFrame:
    """Dates in Chinese numerals; one that the calendar lacks is empty."""
    text = F.get(F.array(*map(F.lit, _HAN)), (F.col("case_id") % len(_HAN)).cast("int"))
    return awards(spark, d).select("case_id", F.coalesce(dates.chinese_date(text).cast("string"), F.lit("")).alias("date"))


@query("m03_amounts", f"WITH {TEXTS} SELECT case_id, TRY_CAST(replace(regexp_extract(text, {_lit(AMOUNT)}, 1), ',', '') AS DOUBLE) AS first, len(regexp_extract_all(text, {_lit(AMOUNT)})) AS n, TRY_CAST(replace(regexp_extract(text, {_lit('(?:请求|主张|要求)[^。；;]*?' + AMOUNT)}, 1), ',', '') AS DOUBLE) AS asked, TRY_CAST(replace(regexp_extract({_DECIDED}, {_lit('(?:支付|支持|补缴|补发|判付)[^。；;]*?' + AMOUNT)}, 1), ',', '') AS DOUBLE) AS awarded FROM texts")
def m03(spark: SparkSession, d: str) -> DataFrame:
    """First amount, number of amounts, amount asked and amount awarded."""
    number = lambda text, before="": F.replace(F.regexp_extract(text, before + AMOUNT, 1), F.lit(","), F.lit("")).try_cast("double")
    decided = F.col("decided")
    return awards(spark, d).select("case_id", number(the_text()).alias("first"), F.regexp_count(the_text(), F.lit(AMOUNT)).cast("long").alias("n"), number(the_text(), "(?:请求|主张|要求)[^。；;]*?").alias("asked"), number(decided, "(?:支付|支持|补缴|补发|判付)[^。；;]*?").alias("awarded"))


@query("m04_amount_outcome", f"WITH {TEXTS}, s AS (SELECT case_id, amount AS asked, TRY_CAST(replace(regexp_extract({_DECIDED}, {_lit(AMOUNT)}, 1), ',', '') AS DOUBLE) AS awarded FROM texts) SELECT case_id, CASE WHEN asked IS NULL OR awarded IS NULL OR asked <= 0 THEN 'unclear' WHEN awarded <= 0 THEN 'not_supported' WHEN awarded >= asked THEN 'supported' ELSE 'partially_supported' END AS outcome FROM s")
def m04(spark: SparkSession, d: str) -> DataFrame:
    decided = F.col("decided")
    awarded = F.replace(F.regexp_extract(decided, AMOUNT, 1), F.lit(","), F.lit("")).try_cast("double")
    return awards(spark, d).select("case_id", dates.amount_outcome(F.col("amount"), awarded).alias("outcome"))


_ORDERED_PAY = "'(?:支付|赔偿|补偿)[一-龥\\s]*?([0-9]+(?:\\.[0-9]+)?)\\s*元'"


@query("m05_total_awarded", f"WITH {TEXTS} SELECT case_id, nullif(round(list_sum(list_filter(list_transform(regexp_extract_all({_DECIDED}, {_ORDERED_PAY}, 1), lambda x: x::DOUBLE), lambda x: x < 5000000)), 2), 0) AS total FROM texts")
def m05(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the amounts below five million that a decision orders to pay; null if there is none."""
    decided = F.col("decided")
    found = F.filter(F.transform(F.regexp_extract_all(decided, F.lit("(?:支付|赔偿|补偿)[一-龥\\s]*?([0-9]+(?:\\.[0-9]+)?)\\s*元"), F.lit(1)), lambda x: x.cast("double")), lambda x: x < 5000000)
    return awards(spark, d).select("case_id", F.nullif(F.round(F.aggregate(found, F.lit(0.0), lambda a, x: a + x), 2), F.lit(0.0)).alias("total"))


_WEIGHTS = [("case_number", 15), ("date", 10), ("committee", 10), ("parties", 15), ("claims", 15), ("facts", 10), ("reasoning", 15), ("decision", 10)]
_FIELDS_SQL = f"""f AS (SELECT case_id, regexp_matches(text, {_lit(t.CASE_NUMBER)}) AS case_number, case_id % 5 <> 0 AS date, regexp_matches(text, {_lit(t.COMMITTEE)}) AS committee, contains(text, '申请人：') AS parties,
    coalesce({_section(_CLEAN, *_SECTION['claims'])}, '') <> '' AS claims, case_id % 7 <> 0 AS facts, case_id % 3 <> 0 AS reasoning, coalesce({_section(_CLEAN, *_SECTION['decision'])}, '') <> '' AS decision FROM texts)"""


@query("m14_quality_score", f"WITH {TEXTS}, {_FIELDS_SQL}, s AS (SELECT case_id, " + " + ".join(f"CASE WHEN {n} THEN {w} ELSE 0 END" for n, w in _WEIGHTS) + " AS score, array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT {n} THEN '{n}' END" for n, _ in _WEIGHTS) + "], lambda x: x IS NOT NULL), ',') AS missing FROM f) SELECT case_id, score, missing, CASE WHEN score >= 75 THEN 'success' WHEN score >= 40 THEN 'partial' ELSE 'failed' END AS status FROM s")
def m14(spark: SparkSession, d: str) -> DataFrame:
    """A score of which fields a parser found, the fields it missed, and the status by thresholds."""
    k = F.col("case_id")
    some = lambda name: F.coalesce(section(name), F.lit("")) != ""
    have = {"case_number": the_text().rlike(t.CASE_NUMBER), "date": k % 5 != 0, "committee": the_text().rlike(t.COMMITTEE), "parties": F.contains(the_text(), F.lit("申请人：")), "claims": some("claims"), "facts": k % 7 != 0, "reasoning": k % 3 != 0, "decision": some("decision")}
    f = awards(spark, d).select("case_id", *(c.alias(n) for n, c in have.items()))
    score = sum((F.when(F.col(n), w).otherwise(0) for n, w in _WEIGHTS), F.lit(0))
    missing = F.array_join(F.array_compact(F.array(*(F.when(~F.col(n), F.lit(n)) for n, _ in _WEIGHTS))), ",")
    return f.select("case_id", score.alias("score"), missing.alias("missing")).withColumn("status", F.when(F.col("score") >= 75, "success").when(F.col("score") >= 40, "partial").otherwise("failed"))


_CATEGORIES = [("identity", 25), ("parties", 20), ("dispute", 10), ("claims", 15), ("defense", 10), ("evidence", 10), ("reasoning", 10)]


@query("m13_completeness", f"WITH {TEXTS}, r AS (SELECT case_id, [regexp_matches(text, {_lit(t.CASE_NUMBER)})::INT, regexp_matches(text, {_lit(t.COMMITTEE)})::INT] AS identity, [1, regexp_matches(text, '公司|厂|企业')::INT] AS parties, [{_any('text', '解除 工资 社会保险')}::INT] AS dispute, [contains(text, '申请人主张')::INT, regexp_matches(text, '[0-9]元')::INT] AS claims, [{_any('text', '旷工 离职 加班 考核')}::INT] AS defense, [{_any('text', '考勤 工资表 录音')}::INT] AS evidence, [{_any('text', '举证 程序 采信')}::INT] AS reasoning FROM texts), s AS (SELECT case_id, round(" + " + ".join(f"{w} * list_avg({n})" for n, w in _CATEGORIES) + ", 1) AS score FROM r) SELECT case_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM s")
def m13(spark: SparkSession, d: str) -> DataFrame:
    """Weighted completeness: each category counts by the share of its checks that hold."""
    checks = {
        "identity": [the_text().rlike(t.CASE_NUMBER), the_text().rlike(t.COMMITTEE)], "parties": [F.lit(True), the_text().rlike("公司|厂|企业")], "dispute": [rules.has_any(the_text(), "解除 工资 社会保险")], "claims": [F.contains(the_text(), F.lit("申请人主张")), the_text().rlike("[0-9]元")],
        "defense": [rules.has_any(the_text(), "旷工 离职 加班 考核")], "evidence": [rules.has_any(the_text(), "考勤 工资表 录音")], "reasoning": [rules.has_any(the_text(), "举证 程序 采信")],
    }
    score = sum((w * sum((c.cast("int") for c in checks[n]), F.lit(0)) / len(checks[n]) for n, w in _CATEGORIES), F.lit(0.0))
    out = awards(spark, d).select("case_id", F.round(score, 1).alias("score"))
    return out.withColumn("grade", F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").otherwise("D"))
