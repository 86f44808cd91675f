"""Queries over court judgments: parties, sections, orders, claims, references, diagnoses and outcomes.

The SQL reads the same texts by joins with tables of rules, steps of a fold and
windows, where the DataFrame works on arrays within a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import court_tables as c
from verdigris.functions.claims import CLAIM_FIELDS
from verdigris.functions.diagnoses import RULE_REASONS
from verdigris.operators import audits, judgments
from verdigris.plans.registry import query
from verdigris.sources.judgments import COURT, court_texts
from verdigris.sources.tables import CASES
from verdigris.sources.tables import cases as city_cases


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_q, items)) + "]::VARCHAR[]"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_q(pattern)})"


_BLANK = "' ' || chr(10) || chr(13) || chr(9) || chr(160) || '　'"


def _strip(x: str) -> str:
    return f"trim({x}, {_BLANK})"


def _first(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {_q(pattern)}, {group}), '')"


def _number(text: str, pattern: str = c.AMOUNT) -> str:
    return f"TRY_CAST(replace(regexp_extract({text}, {_q(pattern)}, 1), ',', '') AS DOUBLE)"


def _case(text: str, table: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(text, p)} THEN {_q(n)}" for n, p in table) + f" ELSE {other} END"


def _clean(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '[（\\(].*?[）\\)]', '', 'g'), '[,，。、：:].*$', '', 'g'), '[\\s 　]+', '', 'g')"


def _firm(x: str) -> str:
    return f"coalesce({_has(x, c.FIRM)}, false)"


def _person(x: str) -> str:
    han = f"regexp_replace({x}, '[^一-龥]', '', 'g')"
    return f"coalesce(NOT {_has(x, c.FIRM)} AND length({han}) BETWEEN 2 AND 5 AND NOT {_has(han, c.NO_PERSON)}, false)"


def _context(text: str) -> str:
    """A word of the rule is in the text, with a word of its context about one of its places."""
    places = f"list_filter(range(1, length({text}) + 1), lambda p: substr({text}, p, length(w)) = w)"
    near = f"len(list_filter({places}, lambda p: len(list_filter(context, lambda k: contains(substr({text}, greatest(p - {c.AROUND}, 1), p - greatest(p - {c.AROUND}, 1) + length(w) + {c.AROUND}), k))) > 0)) > 0"
    return f"len(list_filter(words, lambda w: contains({text}, w) AND (len(context) = 0 OR {near}))) > 0"


def _has_word(text: str) -> str:
    return f"len(list_filter(words, lambda w: contains({text}, w))) > 0"


def _asks(s: str) -> str:
    flat = _strip(f"regexp_replace({s}, '[\\s 　]+', ' ', 'g')")
    return f"(NOT {_has(flat, c.DEFENCE_MARK)} AND ({_has(flat, c.REQUEST_MARK)} OR len(list_filter(words, lambda w: contains({flat}, w) AND {_has(f'left({flat}, strpos({flat}, w) - 1)', c.REQUEST_BEFORE)})) > 0))"


def _fragments(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {_q(c.SENTENCES)}), lambda s: {_strip('s')}), lambda s: s <> '')"


_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, {_q(r.name)}, {_q(r.type)}, {_list(r.words)}, {_list(r.context)}, {str(r.from_request).lower()})" for i, r in enumerate(c.CLAIM_RULES)) + ") AS r(k, name, type, words, context, from_request))"
_ROLES = "roles AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in c.PROCEDURAL_ROLES.items()) + ") AS r(label, role))"
_NAME_OK = (
    f"name <> '' AND length(name) <= 60 AND NOT regexp_matches(name, '[！!？?]') AND NOT {_has('name', c.STATEMENT)} AND NOT {_has('name', c.NO_NAME)} "
    f"AND ({_has('name', c.ORGANISATION)} OR ({_has('name', c.PERSON)} AND NOT {_has('name', c.NO_NAME_END)}))"
)
_TITLED = f"(a IS NULL OR b IS NULL) AND title IS NOT NULL"
PARTIES = f"""{COURT}, {_ROLES},
body AS (SELECT case_id, {_strip("coalesce(text, '')")} AS text, title, coalesce(request, '') AS request FROM court),
heads AS (SELECT *, CASE WHEN e <> '' THEN left(text, strpos(text, e) - 1) ELSE left(text, {c.IDENTITY_LENGTH}) END AS head FROM (SELECT *, regexp_extract(text, {_q(c.IDENTITY_ENDS)}) AS e FROM body)),
named AS (SELECT case_id, label, {_clean("raw")} AS name, i FROM (SELECT case_id, unnest(regexp_extract_all(head, {_q(c.PARTY)}, 1)) AS label, unnest(regexp_extract_all(head, {_q(c.PARTY)}, 2)) AS raw, unnest(range(len(regexp_extract_all(head, {_q(c.PARTY)}, 1)))) AS i FROM heads)),
candidates AS (SELECT *, CASE WHEN list_contains({_list(c.FIRST_SIDE)}, label) THEN 0 WHEN list_contains({_list(c.SECOND_SIDE)}, label) THEN 1 END AS side FROM named WHERE {_NAME_OK}),
sided AS (SELECT h.case_id, h.text, h.head, h.request, h.title, arg_min(name, i) FILTER (side = 0) AS a, arg_min(name, i) FILTER (side = 1) AS b, arg_min(name, side * 1000 + i) FILTER (side IS NOT NULL AND {_person("name")}) AS any_person,
    arg_min(name, side * 1000 + i) FILTER (side IS NOT NULL AND {_firm("name")}) AS any_firm, {_first("any_value(h.text)", c.WORKER)} AS worker, {_first("any_value(h.text)", c.WORKER_IN_CONTEXT)} AS person, {_first("any_value(h.text)", c.FIRM_IN_CONTEXT)} AS firm,
    {_clean(_first("h.title", c.TITLE, 1))} AS l, {_clean(_first("h.title", c.TITLE, 2))} AS r FROM heads h LEFT JOIN candidates USING (case_id) GROUP BY h.case_id, h.text, h.head, h.request, h.title),
rungs AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN {_person("a")} AND {_firm("b")} THEN 1 WHEN {_firm("a")} AND {_person("b")} THEN 2 WHEN {_firm("a")} AND {_firm("b")} AND {_person("worker")} THEN 3 WHEN {_firm("a")} AND {_firm("b")} THEN 4 WHEN {_person("a")} AND {_person("b")} THEN 5 ELSE 0 END
    WHEN a IS NOT NULL THEN CASE WHEN {_firm("a")} THEN 6 ELSE 7 END ELSE 0 END AS rung, CASE WHEN {_TITLED} AND {_person("l")} AND {_firm("r")} THEN 1 WHEN {_TITLED} AND {_firm("l")} AND {_person("r")} THEN 2 ELSE 0 END AS titled FROM sided),
sides AS (SELECT *, coalesce(CASE rung WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN worker WHEN 5 THEN a WHEN 7 THEN a END, CASE titled WHEN 1 THEN l WHEN 2 THEN r END, any_person) AS employee0,
    coalesce(CASE rung WHEN 1 THEN b WHEN 2 THEN a WHEN 3 THEN a WHEN 4 THEN a WHEN 5 THEN b WHEN 6 THEN a END, CASE titled WHEN 1 THEN r WHEN 2 THEN l END, any_firm) AS employer0,
    CASE WHEN rung IN (1, 5, 7) THEN 'employee' WHEN rung IN (2, 3, 6) THEN 'employer' ELSE 'unknown' END AS applicant_role, CASE WHEN rung > 0 THEN [0.95, 0.95, 0.75, 0.4, 0.6, 0.5, 0.5][rung] WHEN titled > 0 THEN 0.85 ELSE 0.5 END::DOUBLE AS sure FROM rungs),
known AS (SELECT case_id, text, head, request, coalesce(employee0, CASE WHEN {_person("person")} THEN person END) AS employee, coalesce(employer0, firm) AS employer, applicant_role,
    CASE WHEN (employee0 IS NULL AND {_person("person")}) OR (employer0 IS NULL AND firm IS NOT NULL) THEN greatest(sure, 0.7) ELSE sure END::DOUBLE AS confidence FROM sides),
firsts AS (SELECT case_id, name, row_number() OVER (PARTITION BY case_id ORDER BY min(i)) AS p, arg_min(label, i) AS label FROM candidates GROUP BY case_id, name),
own_roles AS (SELECT DISTINCT case_id, name, coalesce(role, 'unknown') AS role FROM candidates LEFT JOIN roles USING (label)),
answering AS (SELECT case_id, arg_min(name, p) AS name FROM firsts JOIN own_roles USING (case_id, name) WHERE role IN ('defendant', 'respondent') GROUP BY case_id),
all_roles AS (SELECT * FROM own_roles UNION SELECT case_id, name, unnest(['counterclaimPlaintiff', 'counterclaimant']) FROM answering JOIN known USING (case_id) WHERE {_has("head", c.COUNTERCLAIM)}),
parties AS (SELECT case_id, 'party_' || p AS id, p, name, CASE WHEN name = employee THEN 'employee' WHEN name = employer THEN 'employer' WHEN label = '第三人' THEN 'other' ELSE 'unknown' END AS labor_role, (SELECT list(role) FROM all_roles a WHERE a.case_id = f.case_id AND a.name = f.name) AS roles FROM firsts f JOIN known USING (case_id))"""


def cases(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """The judgments with what a query wants of them."""
    return judgments.read(court_texts(spark, d), wanted)


@query("t17_party_recognition", f"WITH {PARTIES} SELECT k.case_id, employee, employer, applicant_role, confidence, p.id AS party_id, p.name, p.labor_role, array_to_string(list_sort(p.roles), ',') AS roles FROM known k LEFT JOIN parties p USING (case_id)")
def t17(spark: SparkSession, d: str) -> DataFrame:
    """Parties with all their sides, and who of them is employee, employer and applicant."""
    rows = cases(spark, d, "known").select("case_id", "known.employee", "known.employer", "known.applicant_role", "known.confidence", F.explode_outer("known.parties").alias("p"))
    return rows.select("case_id", "employee", "employer", "applicant_role", "confidence", F.col("p.id").alias("party_id"), "p.name", "p.labor_role", F.array_join(F.array_sort("p.roles"), ",").alias("roles"))


_PARTS = f"""parts AS (SELECT case_id, text, {_strip(_first("text", c.APPLICANT_SECTION))}[:{c.CLIP}] AS applicant, {_strip(_first("text", c.RESPONDENT_SECTION))}[:{c.CLIP}] AS respondent, {_strip(_first("text", c.FACTS_SECTION))} AS facts,
    {_strip(f'coalesce({_first("text", c.REASONING_SECTION)}, {_first("text", c.REASONING_ELSE)})')} AS reasoning, {_strip(_first("text", c.DECISION_SECTION))} AS decision FROM body)"""


@query("t19_judgment_sections", f"WITH {COURT}, body AS (SELECT case_id, {_strip('text')} AS text FROM court), {_PARTS} SELECT case_id, applicant, respondent, facts, reasoning, decision FROM parts")
def t19(spark: SparkSession, d: str) -> DataFrame:
    """The five sections of a judgment; the reasoning has a second heading where it lacks the first."""
    return cases(spark, d, "parts").select("case_id", "parts.*")


_AGAINST = "list_has_any(roles, ['plaintiff', 'appellant', 'applicant'])"
ORDERS = f"""{PARTIES}, {_RULES}, {_PARTS},
clauses AS (SELECT case_id, unnest(x) AS source, unnest(range(len(x)))::INTEGER AS pos FROM (SELECT case_id, list_filter(list_transform(regexp_split_to_array(coalesce(decision, ''), {_q(c.CLAUSES)}), lambda s: {_strip('s')}), lambda s: s <> '') AS x FROM parts)),
kinds AS (SELECT case_id, pos, arg_min(type, k) AS type FROM clauses, rules WHERE {_context('source')} OR (type = '{c.CONFIRMATION}' AND {_has('source', c.CONFIRMS)}) GROUP BY case_id, pos),
payments AS (SELECT case_id, pos, source, strpos(source, e) AS paid FROM (SELECT *, regexp_extract(source, {_q(c.PAYMENT)}) AS e FROM clauses) WHERE e <> ''),
places AS (SELECT q.case_id, q.pos, p.p, p.roles, q.paid, list_filter(range(1, length(source) + 1), lambda i: substr(source, i, length(name)) = name) AS found FROM payments q JOIN parties p USING (case_id) WHERE labor_role IN ('employee', 'employer')),
nearest AS (SELECT case_id, pos, arg_min(roles, (far, p)) AS roles FROM (SELECT *, abs(paid - coalesce(list_max(list_filter(found, lambda i: i <= paid)), list_min(list_filter(found, lambda i: i >= paid)))) AS far FROM places) WHERE far IS NOT NULL GROUP BY case_id, pos),
against AS (SELECT case_id, arg_min(list_contains(roles, 'appellant'), p) AS appeals FROM parties WHERE labor_role = 'employer' AND {_AGAINST} GROUP BY case_id),
acts AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS n FROM (SELECT c.case_id, c.pos, c.source, {_case('c.source', c.ACTIONS, "'unclear'")} AS action, k.type, {_number('c.source', c.ASKED)} AS asked,
    CASE WHEN n.roles IS NOT NULL THEN CASE {" ".join(f"WHEN list_contains(n.roles, '{r}') THEN '{r}'" for r in c.BENEFICIARY)} ELSE 'unknown' END WHEN {_has('c.source', c.AGAINST_FIRM)} THEN CASE WHEN g.appeals THEN 'appellant' ELSE 'plaintiff' END ELSE {_case('c.source', c.TARGETS, "'unknown'")} END AS target
    FROM clauses c LEFT JOIN kinds k USING (case_id, pos) LEFT JOIN nearest n USING (case_id, pos) LEFT JOIN against g ON g.case_id = c.case_id) WHERE action <> 'unclear' OR type IS NOT NULL),
runs AS (SELECT *, sum(CASE WHEN type IS NOT NULL OR action = 'unclear' OR {_has('source', c.NOT_CONTINUED)} THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY pos) AS run FROM acts),
orders_ AS (SELECT case_id, pos, source, action, target, first_value(type) OVER (PARTITION BY case_id, run ORDER BY pos) AS type, type IS NULL AND first_value(type) OVER (PARTITION BY case_id, run ORDER BY pos) IS NOT NULL AS carried, asked,
    CASE WHEN action = 'reject' THEN 0.0 ELSE coalesce({_number('source', c.AWARDED)}, CASE WHEN action = 'pay' THEN {_number('source')} END) END::DOUBLE AS awarded FROM runs)"""


@query("t21_addressed_orders", f"WITH {ORDERS} SELECT case_id, pos, source, action, target, type, carried, asked, awarded FROM orders_")
def t21(spark: SparkSession, d: str) -> DataFrame:
    """Orders with whom they are addressed to and the claim that they are about, carried on where a clause names none."""
    return cases(spark, d, "orders").select("case_id", F.explode("orders").alias("o")).select("case_id", "o.*")


def _pick(name: str, sources: list[tuple[str, str, str, str]], usable: str) -> str:
    """The first usable fragment by claim: sources are (where, its rank, kind, field)."""
    unions = " UNION ALL ".join(f"SELECT case_id, k, words, context, {rank} AS rank, {where} AS origin, {kind} AS kind0, {field} AS field FROM wanted" for where, rank, kind, field in sources)
    return (
        f"{name}_o AS ({unions}), {name}_f AS (SELECT case_id, k, words, kind0, field, rank, unnest(f) AS s, unnest(range(len(f))) AS i FROM (SELECT *, {_fragments('origin')} AS f FROM {name}_o WHERE origin <> '' AND (len(context) = 0 OR {_context('origin')}))), "
        f"{name} AS (SELECT case_id, k, arg_min(s, (rank, i)) AS s, arg_min(kind0, (rank, i)) AS kind0, arg_min(field, (rank, i)) AS field, min(rank) AS rank FROM {name}_f WHERE {_has_word('s')} AND {_asks('s')} AND {usable} GROUP BY case_id, k)"
    )


def _party(role: str, sides: str) -> str:
    return f"coalesce((SELECT arg_min(p.id, p.p) FROM parties p WHERE p.case_id = x.case_id AND p.labor_role = {role} AND list_has_any(p.roles, {sides})), (SELECT arg_min(p.id, p.p) FROM parties p WHERE p.case_id = x.case_id AND p.labor_role = {role}))"


def _near(text: str) -> str:
    order = f"list_sort(list_filter(list_transform(words, lambda w: {{'i': strpos({text}, w), 'n': -length(w)}}), lambda y: y.i > 0))"
    return f"list_filter(list_transform({order}, lambda y: {_number(f'substr({text}, y.i, {c.NEAR} - y.n)')}), lambda v: v IS NOT NULL)[1]"


def _last(text: str, part: str) -> str:
    """Where part comes last in text; null if it doesn't."""
    return f"CASE WHEN {part} <> '' AND contains({text}, {part}) THEN length({text}) - strpos(reverse({text}), reverse({part})) - length({part}) + 2 END"


_ARBITRATION, _APPEAL = _has("s", c.ARBITRATION_MARK), _has("s", c.APPEAL_MARK)
_DONE, _TO = "o.action IN ('support', 'pay')", "o.target IN ('plaintiff', 'appellee', 'defendant')"
_OWN = "FROM orders_ o WHERE o.case_id = x.case_id AND o.type = x.type"
_EXISTS = lambda more: f"EXISTS (SELECT 1 {_OWN} AND {more})"
_EMPLOYEES = "['plaintiff', 'appellee', 'defendant']"
_MONETARY = ", ".join(map(_q, c.MONETARY))
CLAIMS = f"""{ORDERS},
scoped AS (SELECT k.*, p.applicant, p.respondent, coalesce(p.decision, '') AS decision, CASE WHEN least(d, g) IS NOT NULL THEN left(k.text, least(d, g) - 1) ELSE k.text END AS scope, CASE WHEN d IS NOT NULL THEN left(k.text, d - 1) ELSE k.text END AS until,
    k.applicant_role = 'employer' OR EXISTS (SELECT 1 FROM parties q WHERE q.case_id = k.case_id AND q.labor_role = 'employer' AND list_contains(q.roles, 'appellant')) AS appealed
    FROM known k JOIN parts p USING (case_id) JOIN (SELECT case_id, {_last('text', "coalesce(decision, '')")} AS d, nullif(strpos(text, nullif(regexp_extract(text, {_q(c.DISPOSITION)}), '')), 0) AS g FROM parts) USING (case_id)),
fold AS (SELECT case_id, 0 AS k, text AS rest, scope, false AS taken FROM scoped UNION ALL
    SELECT case_id, k, CASE WHEN m THEN list_reduce(list_prepend(rest, words), lambda t, w: replace(t, w, '')) ELSE rest END, scope, m FROM (SELECT f.case_id, r.k, f.rest, f.scope, words, {_context('f.rest')} AND (NOT from_request OR {_context('f.scope')}) AS m FROM fold f JOIN rules r ON r.k = f.k + 1)),
wanted AS (SELECT s.*, r.k, r.name, r.type, r.words, r.context FROM fold f JOIN rules r USING (k) JOIN scoped s USING (case_id) WHERE f.taken),
{_pick("section_", [("request", "0", "'litigation_request'", "'ssjl'"), ("coalesce(applicant, '')", "1", f"CASE WHEN {_has('applicant', c.APPEAL_SECTION)} THEN 'appeal_request' WHEN {_has('applicant', c.ARBITRATION_SECTION)} THEN 'arbitration_request' ELSE 'litigation_request' END", "'fbqw'"), ("coalesce(respondent, '')", "2", "'party_statement'", "'fbqw'"), ("until", "3", "''", "'fbqw'")], f"NOT {_has('s', c.REASONING_MARK)}")},
{_pick("under", [("request", "0", "''", "'ssjl'"), ("scope", "1", "''", "'fbqw'")], f"NOT {_APPEAL}")},
{_pick("own_appeal", [("CASE WHEN appealed THEN coalesce(nullif(applicant, ''), scope) ELSE '' END", "0", "''", "'fbqw'")], _has('s', c.APPEAL_ASKED))},
{_pick("firm_appeal", [("CASE WHEN appealed THEN coalesce(nullif(applicant, ''), scope) ELSE '' END", "0", "employer", "employee")], f"{_has('s', c.APPEAL_ASKED)} AND coalesce(contains(s, kind0), false) AND NOT contains(s, coalesce(field, ''))")},
firsts_ AS (SELECT w.*, coalesce(f.s, '') AS s0, CASE WHEN f.s IS NULL THEN 'unknown' WHEN f.rank = 3 THEN CASE WHEN contains(f.s, '仲裁') THEN 'arbitration_request' WHEN contains(f.s, '上诉') THEN 'appeal_request' ELSE 'litigation_request' END
    WHEN {_has('f.s', c.ARBITRATION_MARK)} THEN 'arbitration_request' WHEN {_has('f.s', c.APPEAL_MARK)} THEN 'appeal_request' ELSE f.kind0 END AS kind1, coalesce(f.field, 'unknown') AS field0, u.s AS s1, CASE WHEN {_has('u.s', c.ARBITRATION_MARK)} THEN 'arbitration_request' ELSE 'litigation_request' END AS kind2, u.field AS field1,
    coalesce(b.s, a.s, '') AS appeal FROM wanted w LEFT JOIN section_ f USING (case_id, k) LEFT JOIN under u USING (case_id, k) LEFT JOIN own_appeal a USING (case_id, k) LEFT JOIN firm_appeal b USING (case_id, k)),
sourced AS (SELECT *, CASE WHEN t THEN s1 ELSE s0 END AS s, CASE WHEN t THEN kind2 ELSE kind1 END AS source_kind, CASE WHEN t THEN field1 ELSE field0 END AS source_field,
    appealed AND len(list_filter({_fragments('scope')}, lambda g: {_has('g', c.APPEAL_STATED)} AND {_has_word('g')} AND coalesce(contains(g, employer), true) AND NOT {_has('g', c.APPEAL_NOT_STATED)})) > 0 AS stated FROM (SELECT *, kind1 = 'appeal_request' AND appealed AND s1 IS NOT NULL AS t FROM firsts_)),
based AS (SELECT *, {_has('s', c.COUNTER_MARK)} AS counter, {_has('s', c.APPEAL_BASIS)} AS appealing, contains(s, '申请人') AND NOT {_has('s', c.COUNTER_MARK)} AS applying, coalesce(contains(s, employee), false) AS names_person, coalesce(contains(s, employer), false) AS names_firm FROM sourced),
claimed AS (SELECT *, CASE WHEN counter THEN 'counterclaim' WHEN appealing THEN 'appeal_request' WHEN applying THEN 'application' ELSE 'original_claim' END AS basis,
    CASE WHEN counter THEN CASE applicant_role WHEN 'employee' THEN 'employer' WHEN 'employer' THEN 'employee' ELSE 'unknown' END WHEN names_person AND NOT names_firm THEN 'employee' WHEN names_firm AND NOT names_person THEN 'employer' ELSE applicant_role END AS role0,
    CASE WHEN counter THEN ['counterclaimant', 'defendant', 'respondent', 'appellee'] WHEN appealing THEN ['appellant'] WHEN applying THEN ['applicant'] ELSE ['plaintiff'] END AS sides0 FROM based),
owned AS (SELECT *, (appealed AND source_kind = 'arbitration_request' AND basis = 'original_claim') OR (applicant_role = 'employer' AND (({_has('s', '被告|被上诉人')} AND {_EXISTS(_DONE)} AND {_EXISTS(_TO)}) OR (type = 'unpaid_remuneration' AND {_EXISTS(f'{_DONE} AND {_TO}')}) OR (s = '' AND {_EXISTS(_DONE)} AND {_EXISTS(_TO)})
    OR (s = '' AND type = '{c.CONFIRMATION}' AND {_EXISTS("o.action = 'support'")} AND {_has('decision', '维持原判|维持原裁决')}))) AS his, (SELECT count(*) {_OWN}) AS n_own FROM claimed x),
parted AS (SELECT *, CASE WHEN his THEN 'employee' ELSE role0 END AS role, CASE WHEN his THEN {_party("'employee'", _EMPLOYEES)} ELSE {_party('role0', 'sides0')} END AS party, CASE WHEN type <> '{c.CONFIRMATION}' THEN coalesce({_near('s')}, (SELECT arg_min(o.asked, o.pos) {_OWN} AND o.asked IS NOT NULL)) END AS asked,
    (SELECT arg_min(o.awarded, o.pos) {_OWN} AND o.awarded IS NOT NULL) AS awarded, (SELECT count(*) {_OWN} AND o.awarded IS NOT NULL) AS n_amounts, (SELECT arg_min(o, o.pos) {_OWN} AND o.awarded IS NOT NULL) AS order1 FROM owned x),
applied AS (SELECT x.case_id, x.k, bool_or({_DONE}) AS gives, bool_or(o.action = 'reject') AS rejects, bool_or({_has('o.source', '全部|全额')}) AS whole FROM parted x JOIN orders_ o ON o.case_id = x.case_id AND CASE WHEN x.n_own > 0 THEN o.type = x.type ELSE o.type IS NULL AND o.target IN ('plaintiff', 'appellant') AND NOT {_has('o.source', c.NOT_GENERIC)} END GROUP BY x.case_id, x.k),
judged AS (SELECT x.*, CASE WHEN rejects AND NOT gives THEN 'not_supported' WHEN rejects THEN 'partially_supported' WHEN gives AND whole THEN 'supported' WHEN n_amounts = 1 AND len(regexp_extract_all(order1.source, {_q(c.AMOUNT)})) <= 1 AND asked > 0 AND awarded >= 0 THEN CASE WHEN awarded = 0 THEN 'not_supported' WHEN awarded < asked THEN 'partially_supported' ELSE 'supported' END
    WHEN gives THEN 'supported' ELSE 'unclear' END AS outcome0 FROM parted x LEFT JOIN applied USING (case_id, k)),
repaired AS (SELECT *, CASE WHEN outcome0 = 'supported' AND type IN ({_MONETARY}) AND asked > awarded AND awarded > 0 AND reliable THEN 'partially_supported' ELSE outcome0 END AS outcome FROM (SELECT *, role IN ('employee', 'employer') AND n_amounts = 1 AND order1.action IN ('pay', 'support') AND order1.target <> 'unknown' AND len(regexp_extract_all(order1.source, {_q(c.AMOUNT)})) <= 1
    AND (SELECT count(*) FROM parties p WHERE p.case_id = x.case_id AND p.labor_role = role AND (party IS NULL OR p.id = party)) = 1 AND (SELECT count(*) FROM parties p WHERE p.case_id = x.case_id AND list_contains(p.roles, x.order1.target)) = 1
    AND (SELECT min(p.id) FROM parties p WHERE p.case_id = x.case_id AND p.labor_role = role AND (party IS NULL OR p.id = party)) = (SELECT min(p.id) FROM parties p WHERE p.case_id = x.case_id AND list_contains(p.roles, x.order1.target)) AS reliable FROM judged x)),
listed AS (SELECT case_id, k * 2 AS n, name, type, role AS claimant_role, party AS claimant_party, basis, outcome, source_kind, source_field, s AS source, asked, awarded, coalesce((SELECT string_agg(o.pos, ',' ORDER BY o.pos) {_OWN}), '') AS orders FROM repaired x
    UNION ALL SELECT case_id, k * 2 + 1, name, type, 'employer', {_party("'employer'", "['appellant', 'plaintiff', 'applicant']")}, 'appeal_request', 'unclear', 'appeal_request', CASE WHEN appeal <> '' THEN 'fbqw' ELSE 'unknown' END, appeal, CASE WHEN appeal <> '' THEN {_near('appeal')} END, NULL, '' FROM repaired x WHERE (appeal <> '' OR stated) AND appeal <> s AND role <> 'employer'),
bare AS (SELECT s.case_id, s.text, s.applicant_role, s.applicant_role AS role, coalesce(list_filter({_fragments('s.text')}, lambda g: {_has('g', c.PROCEDURAL_MARK)} AND NOT {_has(_strip("regexp_replace(g, '[ ]+', ' ', 'g')"), c.DEFENCE_MARK)} AND {_has('g', c.REQUEST_MARK)})[1], '') AS s, {_has('s.text', '上诉人|上诉请求|撤销原判')} AS appealing FROM scoped s),
loose AS (SELECT case_id, bool_or(action = 'support') AS yes, bool_or(action = 'reject') AS no FROM orders_ WHERE type IS NULL AND target IN ('plaintiff', 'appellant') GROUP BY case_id),
with_general AS (SELECT * FROM listed UNION ALL SELECT x.case_id, 0, {_q(c.GENERAL_CLAIM)}, CASE WHEN appealing THEN 'procedural_appeal' ELSE 'general_labor_claim' END, role, {_party('role', "['plaintiff', 'applicant', 'appellant']")}, CASE WHEN appealing THEN 'appeal_request' ELSE 'unknown' END,
    CASE WHEN yes AND no THEN 'partially_supported' WHEN yes THEN 'supported' WHEN no THEN 'not_supported' ELSE 'unclear' END, CASE WHEN s = '' THEN 'unknown' WHEN contains(s, '上诉') THEN 'appeal_request' ELSE 'inferred' END, CASE WHEN s = '' THEN 'unknown' ELSE 'fbqw' END, s, NULL, NULL, '' FROM bare x LEFT JOIN loose USING (case_id) WHERE case_id NOT IN (SELECT case_id FROM listed)),
refused AS (SELECT case_id, min(pos) AS pos FROM orders_ WHERE target = 'appellant' AND action = 'reject' GROUP BY case_id),
every AS (SELECT * FROM with_general UNION ALL SELECT x.case_id, 1000, {_q(c.APPEAL_CLAIM)}, 'procedural_appeal', role, {_party('role', "['appellant', 'plaintiff', 'applicant']")}, 'appeal_request', CASE WHEN pos IS NULL THEN 'unclear' ELSE 'not_supported' END, CASE WHEN s = '' THEN 'unknown' ELSE 'appeal_request' END, CASE WHEN s = '' THEN 'unknown' ELSE 'fbqw' END, s, NULL, NULL, coalesce(pos::VARCHAR, '')
    FROM bare x LEFT JOIN refused USING (case_id) WHERE {_has('text', '上诉人|上诉请求')} AND case_id NOT IN (SELECT case_id FROM with_general WHERE basis = 'appeal_request')),
claims AS (SELECT *, 'claim_' || row_number() OVER (PARTITION BY case_id ORDER BY n) AS id FROM every)"""


@query("t20_claim_provenance", f"WITH RECURSIVE {CLAIMS} SELECT case_id, id, {', '.join(CLAIM_FIELDS)} FROM claims")
def t20(spark: SparkSession, d: str) -> DataFrame:
    """Claims of a judgment with claimant, basis, where the request stands, amounts and outcome."""
    rows = cases(spark, d, "claims").select("case_id", F.explode("claims").alias("x"))
    return rows.select("case_id", "x.id", *(F.array_join(F.transform("x.orders", lambda p: p.cast("string")), ",").alias(k) if k == "orders" else F.col(f"x.{k}") for k in CLAIM_FIELDS))


_OPPOSITE = "CASE applicant0 WHEN 'supported' THEN 'not_supported' WHEN 'not_supported' THEN 'supported' ELSE applicant0 END"
_MERGED = "CASE WHEN bool_or({f} AND status = 'partially_supported') OR (bool_or({f} AND status = 'supported') AND bool_or({f} AND status = 'not_supported')) THEN 'partially_supported' WHEN bool_or({f} AND status = 'supported') THEN 'supported' WHEN bool_or({f} AND status = 'not_supported') THEN 'not_supported' ELSE 'unclear' END"
OUTCOMES = f"""{CLAIMS},
addressed AS (SELECT x.case_id, x.action, x.source, x.target, CASE WHEN x.target = 'unknown' THEN 'unknown' ELSE coalesce((SELECT arg_min(p.labor_role, p.p) FROM parties p WHERE p.case_id = x.case_id AND list_contains(p.roles, x.target)), CASE WHEN x.target IN ('plaintiff', 'appellant', 'applicant') THEN k.applicant_role
    WHEN x.target IN ('defendant', 'appellee', 'respondent') THEN CASE k.applicant_role WHEN 'employee' THEN 'employer' WHEN 'employer' THEN 'employee' ELSE 'unknown' END ELSE 'unknown' END) END AS side FROM orders_ x JOIN known k USING (case_id) WHERE action <> 'unclear'),
statuses AS (SELECT case_id, claimant_role AS side, outcome AS status, false AS loose FROM claims UNION ALL SELECT case_id, side, CASE WHEN action = 'reject' THEN 'not_supported' WHEN action IN ('support', 'pay') THEN 'supported' ELSE 'unclear' END, action = 'reject' AND target = 'unknown' AND contains(source, '其他') FROM addressed),
merged AS (SELECT s.case_id, applicant_role AS role, {_MERGED.format(f="s.side = 'employee'")} AS employee0, {_MERGED.format(f="s.side = 'employer'")} AS employer0, {_MERGED.format(f="s.side = applicant_role")} AS mine, bool_or(s.loose) AS loose FROM statuses s JOIN known USING (case_id) GROUP BY s.case_id, applicant_role),
adjusted AS (SELECT *, CASE WHEN loose AND mine = 'supported' THEN 'partially_supported' ELSE mine END AS applicant0 FROM merged),
outcomes AS (SELECT case_id, role, CASE WHEN role = 'unknown' THEN 'unclear' WHEN employee0 <> 'unclear' THEN employee0 WHEN role = 'employee' THEN applicant0 ELSE {_OPPOSITE} END AS employee, CASE WHEN role = 'unknown' THEN 'unclear' WHEN employer0 <> 'unclear' THEN employer0 WHEN role = 'employer' THEN applicant0 ELSE {_OPPOSITE} END AS employer,
    CASE WHEN role = 'unknown' THEN 'unclear' ELSE applicant0 END AS applicant FROM adjusted)"""


@query("t28_case_outcomes", f"WITH RECURSIVE {OUTCOMES} SELECT case_id, role, employee, employer, applicant FROM outcomes")
def t28(spark: SparkSession, d: str) -> DataFrame:
    """What became of a case for either side: its claims and the orders addressed to it."""
    return cases(spark, d, "known", "outcomes").select("case_id", F.col("known.applicant_role").alias("role"), "outcomes.*")


_DIGIT = lambda x: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in c.DIGITS.items()) + " END"
_ORDINAL = (
    f"CASE WHEN {_has('x', '^[0-9]+$')} THEN TRY_CAST(x AS INTEGER) WHEN x = '十' THEN 10 WHEN contains(x, '十') THEN (CASE WHEN strpos(x, '十') = 1 THEN 1 ELSE {_DIGIT("substr(x, strpos(x, '十') - 1, 1)")} END) * 10 "
    f"+ CASE WHEN strpos(x, '十') = length(x) THEN 0 ELSE {_DIGIT("substr(x, strpos(x, '十') + 1, 1)")} END WHEN length(x) = 1 THEN {_DIGIT('x')} END"
)
_POINTS = "第[一二两三四五六七八九十百〇零\\d]|前[一二两三四五六七八九十\\d]+项|其余|上述|前述|该项请求"


def _references(kind: int, pattern: str) -> str:
    """Each reference of a kind in the points: its numerals, and the text about it between marks."""
    return (
        f"SELECT case_id, pos, source, {kind} AS kind, i, regexp_extract(pieces[i], {_q(pattern)}, 1) AS numerals, regexp_extract(array_to_string(pieces[:i - 1], ''), '[^。；;，,]*$') || pieces[i] || regexp_extract(array_to_string(pieces[i + 1:], ''), '^[^。；;，,]*') AS clause "
        f"FROM (SELECT *, unnest(range(2, len(pieces), 2)) AS i FROM (SELECT *, string_split(regexp_replace(source, {_q('(' + pattern.replace('([', '(?:[', 1) + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS pieces FROM points))"
    )


REFERENCES = f"""{CLAIMS},
points AS (SELECT case_id, pos, source FROM (SELECT case_id, unnest(f) AS source, unnest(range(len(f)))::INTEGER AS pos FROM (SELECT case_id, list_filter(list_transform(regexp_split_to_array(decision, {_q(c.SENTENCES)}), lambda s: {_strip('s')}), lambda s: {_has('s', _POINTS)}) AS f FROM scoped))),
ids AS (SELECT case_id, list(id ORDER BY n) AS ids, coalesce(list(id ORDER BY n) FILTER (orders <> ''), []) AS handled FROM claims GROUP BY case_id),
refs AS ({_references(0, c.NUMBERED)} UNION ALL {_references(1, c.LEADING)}),
numbers AS (SELECT r.*, ids, CASE WHEN kind = 0 THEN list_transform(regexp_split_to_array(numerals, {_q(c.NUMBER_JOINTS)}), lambda x: {_ORDINAL}) ELSE list_transform([numerals], lambda x: {_ORDINAL}) END AS ns FROM refs r JOIN ids USING (case_id)),
sets AS (SELECT *, len(list_filter(ns, lambda n: n IS NULL OR n < 1 OR n > len(ids))) > 0 AS outside FROM numbers),
found AS (SELECT case_id, pos, bool_or(outside) AS outside FROM sets GROUP BY case_id, pos),
reasons AS (SELECT p.*, ids, handled, outside, list_filter(ids, lambda x: NOT list_contains(handled, x)) AS rest, CASE WHEN outside THEN 'ordinal_out_of_range' WHEN outside IS NOT NULL THEN 'deterministic_ordinal_match' WHEN {_has('source', c.REMAINING)} THEN CASE WHEN len(handled) > 0 AND len(list_filter(ids, lambda x: NOT list_contains(handled, x))) > 0
    THEN 'remaining_claims_by_elimination' ELSE 'remaining_claims_without_prior_mapping' END ELSE 'non_deterministic_anaphora' END AS reason FROM points p JOIN ids USING (case_id) LEFT JOIN found USING (case_id, pos)),
chosen AS (SELECT s.case_id, s.pos, s.kind, s.i, list_transform(CASE WHEN s.kind = 0 THEN s.ns ELSE range(1, s.ns[1] + 1) END, lambda n: s.ids[n]) AS claim_ids, s.clause, CASE WHEN s.kind = 1 OR len(s.ns) > 1 THEN 'multi_claim_reference' WHEN {_has('s.source', c.EARLIER_JUDGMENT)} THEN 'appeal_mapping' ELSE 'ordinal_reference' END AS reasoning, 'ordinal' AS method
    FROM sets s JOIN reasons r USING (case_id, pos) WHERE r.reason = 'deterministic_ordinal_match' UNION ALL SELECT case_id, pos, 2, 0, rest, source, 'remaining_claims', 'rule' FROM reasons WHERE reason = 'remaining_claims_by_elimination')"""
_REFERENCE_ROWS = f"""SELECT r.case_id, r.pos, r.source, CASE WHEN k.clause IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, r.reason, array_to_string(k.claim_ids, ',') AS claim_ids, CASE WHEN k.clause IS NOT NULL THEN {_case('k.clause', c.TREATMENTS, "'unclear'")} END AS treatment,
    CASE WHEN k.clause IS NOT NULL THEN {_case('k.clause', c.REFERENCE_ACTIONS, 'NULL')} END AS action, k.reasoning, k.method FROM reasons r LEFT JOIN chosen k USING (case_id, pos)"""


@query("t33_reference_sets", f"WITH RECURSIVE {REFERENCES} {_REFERENCE_ROWS}")
def t33(spark: SparkSession, d: str) -> DataFrame:
    """Clauses that refer to claims by number, as sets of claims; what lies out of range leaves a clause open."""
    rows = judgments.resolve_references(cases(spark, d, "parts", "claims")).select("case_id", "pos", "source", "status", "reason", F.explode_outer("candidates").alias("x"))
    return rows.select("case_id", "pos", "source", "status", "reason", F.array_join("x.claim_ids", ",").alias("claim_ids"), "x.treatment", "x.action", "x.reasoning", "x.method")


_CONFLICT = f"""(outcome = 'supported' AND type IN ({_MONETARY}) AND coalesce(asked > awarded AND awarded > 0, false) AND NOT coalesce(claimant_role IN ('employee', 'employer') AND n_amounts = 1 AND order1.action IN ('pay', 'support') AND order1.target <> 'unknown' AND order1.awarded = awarded AND order1.type = type
    AND len(regexp_extract_all(order1.source, {_q(c.AMOUNT)})) <= 1 AND claimants = 1 AND gaining = 1 AND claimant_id = gaining_id, false))"""
DIAGNOSES = f"""{OUTCOMES},
items AS (SELECT x.case_id, x.id, count(o.pos) AS n_items, coalesce(bool_or({_has('o.source', c.PAYMENT)} AND o.target = 'unknown'), false) AS unpaid, coalesce(bool_or(o.action = 'reject' AND o.target = 'unknown'), false) AS unrejected, coalesce(bool_or(o.action IN ('support', 'reject')), false) AS judged,
    count(o.awarded) AS n_amounts, arg_min(o, o.pos) FILTER (o.awarded IS NOT NULL) AS order1 FROM claims x LEFT JOIN orders_ o ON o.case_id = x.case_id AND list_contains(string_split(x.orders, ','), o.pos::VARCHAR) GROUP BY x.case_id, x.id),
looked AS (SELECT x.*, i.* EXCLUDE (case_id, id), s.decision, k.confidence < 0.6 AS unsure, count(*) OVER (PARTITION BY x.case_id) AS n_claims, (SELECT count(*) FROM parties p WHERE p.case_id = x.case_id AND p.labor_role = x.claimant_role AND (x.claimant_party IS NULL OR p.id = x.claimant_party)) AS claimants,
    (SELECT min(p.id) FROM parties p WHERE p.case_id = x.case_id AND p.labor_role = x.claimant_role AND (x.claimant_party IS NULL OR p.id = x.claimant_party)) AS claimant_id, (SELECT count(*) FROM parties p WHERE p.case_id = x.case_id AND list_contains(p.roles, i.order1.target)) AS gaining,
    (SELECT min(p.id) FROM parties p WHERE p.case_id = x.case_id AND list_contains(p.roles, i.order1.target)) AS gaining_id FROM claims x JOIN items i USING (case_id, id) JOIN scoped s USING (case_id) JOIN known k USING (case_id)),
faces AS (SELECT k.case_id, k.employee, k.employer, k.applicant_role, coalesce(bool_or(p.labor_role = 'unknown'), false) AS undecided, CASE WHEN count(p.id) > 0 THEN 'missing_labor_role' ELSE 'missing_party_roles' END AS no_roles FROM known k LEFT JOIN parties p USING (case_id) GROUP BY k.case_id, k.employee, k.employer, k.applicant_role),
diagnosed AS (SELECT case_id, 'applicant' AS target, NULL AS claim_id, NULL AS claim_type, 'unclear' AS outcome, no_roles AS reason FROM faces WHERE applicant_role = 'unknown'
    UNION ALL SELECT case_id, 'claim', id, type, outcome, CASE WHEN claimant_role = 'unknown' THEN 'missing_claim_owner' WHEN source = '' AND decision = '' THEN 'source_text_missing' WHEN type IN ('general_labor_claim', 'unknown') OR contains(name, '综合请求') THEN 'unsupported_claim_type'
    WHEN basis = 'appeal_request' AND {_has('decision', '维持原判|维持原裁决')} AND NOT judged THEN 'appeal_inheritance_unclear' WHEN {_CONFLICT} THEN 'amount_conflict' WHEN unpaid THEN 'payment_beneficiary_unclear' WHEN unrejected OR (n_items = 0 AND {_has('decision', '驳回|不予支持|无需支付')}) THEN 'rejection_owner_unclear'
    WHEN n_claims > 1 AND {_has('source', '及|、|与')} AND n_items = 0 THEN 'ambiguous_multiple_claims' WHEN decision = '' THEN 'missing_disposition_text' WHEN n_items = 0 THEN 'disposition_not_matched' WHEN unsure THEN 'low_confidence' ELSE 'unknown' END FROM looked WHERE outcome = 'unclear' OR unsure OR unpaid OR unrejected OR {_CONFLICT}
    UNION ALL SELECT f.case_id, t.side, NULL, NULL, 'unclear', CASE WHEN f.applicant_role = 'unknown' THEN no_roles WHEN f.employee IS NULL OR f.employer IS NULL OR undecided THEN 'missing_labor_role' WHEN s.decision = '' THEN 'missing_disposition_text' ELSE 'disposition_not_matched' END
    FROM faces f JOIN outcomes o USING (case_id) JOIN scoped s USING (case_id), (VALUES ('employee'), ('employer'), ('applicant')) AS t(side) WHERE CASE t.side WHEN 'employee' THEN o.employee WHEN 'employer' THEN o.employer ELSE o.applicant END = 'unclear' AND NOT (t.side = 'applicant' AND f.applicant_role = 'unknown'))"""


@query("t27_case_diagnoses", f"WITH RECURSIVE {DIAGNOSES} SELECT *, CASE WHEN reason IN ({', '.join(map(_q, RULE_REASONS))}) THEN 'rule_improvement' ELSE 'manual_review' END AS suggestion FROM diagnosed")
def t27(spark: SparkSession, d: str) -> DataFrame:
    """Why an outcome isn't known, for the case, each claim and each side: the whole ladder of reasons."""
    rows = cases(spark, d, "diagnostics").select("case_id", F.explode("diagnostics").alias("x"))
    return rows.select("case_id", "x.target", "x.claim_id", "x.claim_type", "x.outcome", "x.reason", "x.suggestion")


_SHARE = "CASE WHEN {w} > 0 THEN floor({p}::DOUBLE / {w} * 1000 + 0.5) / 10 ELSE 0 END"
_AUDIT = f"""{DIAGNOSES},
flagged AS (SELECT x.*, EXISTS (SELECT 1 FROM diagnosed g WHERE g.case_id = x.case_id AND (g.claim_id = x.id OR (g.claim_id IS NULL AND g.claim_type = x.type))) AS review FROM claims x),
items_ AS (SELECT reason, CASE WHEN reason IN ({', '.join(map(_q, RULE_REASONS))}) THEN 'rule_improvement' ELSE 'manual_review' END AS suggestion FROM diagnosed),
sums AS (SELECT (SELECT count(*) FROM court) AS cases, count(*) AS claims, count(*) FILTER (WHERE outcome <> 'unclear') AS resolved, count(*) FILTER (WHERE outcome = 'unclear') AS unclear, count(*) FILTER (WHERE review) AS needs_review, (SELECT count(*) FROM items_) AS review_items FROM flagged)
SELECT 'total' AS section, key, n, 0 AS needs_review, CASE WHEN key IN ('cases', 'review_items') THEN 0 ELSE {_SHARE.format(p='n', w='claims')} END AS share FROM (SELECT claims, unnest(['cases', 'claims', 'resolved', 'unclear', 'needs_review', 'review_items']) AS key, unnest([cases, claims, resolved, unclear, needs_review, review_items]) AS n FROM sums)
UNION ALL SELECT 'outcome', o, count(f.id), count(*) FILTER (WHERE review), {_SHARE.format(p='count(f.id)', w='any_value(s.claims)')} FROM (SELECT unnest(['supported', 'partially_supported', 'not_supported', 'unclear']) AS o) LEFT JOIN flagged f ON f.outcome = o, sums s GROUP BY o
UNION ALL SELECT 'claim_type', type, count(*), count(*) FILTER (WHERE review), {_SHARE.format(p="count(*) FILTER (WHERE outcome = 'unclear')", w='count(*)')} FROM flagged GROUP BY type
UNION ALL SELECT 'reason', reason, count(*), 0, {_SHARE.format(p='count(*)', w='any_value(review_items)')} FROM items_, sums GROUP BY reason
UNION ALL SELECT 'suggestion', suggestion, count(*), 0, {_SHARE.format(p='count(*)', w='any_value(review_items)')} FROM items_, sums GROUP BY suggestion"""


@query("a26_outcome_audit", f"WITH RECURSIVE {_AUDIT}")
def a26(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of claims and their outcomes, with reasons, types and suggestions of what needs review."""
    return audits.outcome_audit(cases(spark, d, "claims", "diagnostics"))


@query("a26_amount_risks", f"WITH RECURSIVE {CLAIMS} SELECT case_id, id AS claim_id, type, name, asked, awarded FROM claims WHERE type IN ({_MONETARY}) AND outcome = 'supported' AND awarded > 0 AND awarded < asked")
def a26_risks(spark: SparkSession, d: str) -> DataFrame:
    """Claims granted in full although less is awarded than asked."""
    return audits.amount_risks(cases(spark, d, "claims"))


@query(
    "a25_run_quality",
    f"""WITH {CASES}, r AS (SELECT city, year, amount >= 15000 AS there, amount >= 15000 AND level <> '4-NOT SPECIFIED' AS counted, outcome FROM cases),
    s AS (SELECT city, year, count(*) AS expected, count(*) FILTER (WHERE there) AS available, count(*) FILTER (WHERE counted) AS included, count(*) FILTER (WHERE counted AND outcome = 'unclear') AS unknown FROM r GROUP BY city, year),
    t AS (SELECT city, sum(expected)::BIGINT AS expected, sum(available)::BIGINT AS available, sum(included)::BIGINT AS included, sum(unknown)::BIGINT AS unknown, count(*) FILTER (WHERE available = 0) AS lost, count(*) FILTER (WHERE available > 0 AND available < expected) AS thinned FROM s GROUP BY city)
    SELECT city, expected, available, expected - available AS missing, included, available - included AS excluded, unknown, round(available::DOUBLE / expected, 4) AS coverage, CASE WHEN included > 0 THEN round(unknown::DOUBLE / included, 4) ELSE 0 END AS unknown_rate,
    array_to_string(list_filter([CASE WHEN expected > available THEN 'MISSING_ANALYSIS_RECORDS' END, CASE WHEN available = 0 THEN 'EMPTY_ANALYSIS_INPUT' END, CASE WHEN available > 0 AND included = 0 THEN 'NO_ANALYTICS_ELIGIBLE_RECORDS' END, CASE WHEN included BETWEEN 1 AND 29 THEN 'SMALL_SAMPLE' END, CASE WHEN included > 0 AND unknown::DOUBLE / included > 0.1 THEN 'HIGH_UNKNOWN_OUTCOME_RATE' END,
    CASE WHEN lost > 0 THEN 'STRATUM_MISSING_AFTER_PROCESSING:' || lost END, CASE WHEN thinned > 0 THEN 'STRATUM_ATTRITION:' || thinned END], lambda x: x IS NOT NULL), ',') AS issues, CASE WHEN available = 0 THEN 'blocked' WHEN expected > available OR included < 30 OR unknown::DOUBLE / included > 0.1 OR lost > 0 OR thinned > 0 THEN 'warning' ELSE 'pass' END AS status FROM t""",
)
def a25(spark: SparkSession, d: str) -> DataFrame:
    """Quality of a run over each city, by years as strata: what is missing, left out, unknown, thinned."""
    records = city_cases(spark, d)
    return audits.run_quality(records, run="city", stratum="year", available=F.col("amount") >= 15000, eligible=F.col("level") != "4-NOT SPECIFIED", outcome="outcome")
