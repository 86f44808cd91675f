"""Claims of a court judgment: what was asked by whom, where it says so, and what became of it.

One fold over the rules carries the text that is left: the words of a claim that
was found are taken out before the next is looked for, so that a short name
inside a long one is no second claim.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions import court_tables as c
from verdigris.functions.fragments import KEPT, amount_count, amount_near, compiled, first_name, found, fragments, has, has_word, in_context, is_request, number, strip
from verdigris.functions.parties import party_id

SECTIONS = "struct<applicant:string,respondent:string,facts:string,reasoning:string,decision:string>"
ORDERS = "array<struct<pos:int,source:string,action:string,target:string,type:string,carried:boolean,asked:double,awarded:double>>"
CLAIM_FIELDS = ["name", "type", "claimant_role", "claimant_party", "basis", "outcome", "source_kind", "source_field", "source", "asked", "awarded", "orders"]
CLAIMS = "array<struct<id:string,name:string,type:string,claimant_role:string,claimant_party:string,basis:string,outcome:string,source_kind:string,source_field:string,source:string,asked:double,awarded:double,orders:array<int>>>"
_PATTERNS = {"applicant": (c.APPLICANT_SECTION,), "respondent": (c.RESPONDENT_SECTION,), "facts": (c.FACTS_SECTION,), "reasoning": (c.REASONING_SECTION, c.REASONING_ELSE), "decision": (c.DECISION_SECTION,)}


class Sections(dict):
    """applicant, respondent, facts, reasoning and decision of a text, each looked for when it is asked for; None where a heading is missing."""

    def __init__(self, text: str) -> None:
        super().__init__()
        self.text = text

    def __missing__(self, name: str) -> str | None:
        got = next((x for p in _PATTERNS[name] if (x := found(self.text, p)) is not None), None)
        got = None if got is None else strip(got)
        self[name] = got[: c.CLIP] if got and name in ("applicant", "respondent") else got
        return self[name]

    def all(self) -> dict[str, str | None]:
        return {name: self[name] for name in _PATTERNS}


def _before_last(text: str, part: str) -> int | None:
    at = text.rfind(part) if part else -1
    return at if at >= 0 else None


def before_disposition(text: str, decision: str) -> str:
    """The text before what is decided: before the last place of the decision or the first heading of one, whichever is earlier."""
    heading = compiled(c.DISPOSITION).search(text)
    at = [x for x in (_before_last(text, decision), heading.start() if heading else None) if x is not None]
    return text[: min(at)] if at else text


def amount_outcome(asked: Column, awarded: Column) -> Column:
    """What the amounts alone say; null where one is missing or nothing was asked."""
    return F.when((asked > 0) & (awarded >= 0), F.when(awarded == 0, "not_supported").when(awarded < asked, "partially_supported").otherwise("supported"))


def _by_amounts(asked: float | None, awarded: float | None) -> str | None:
    if asked is None or awarded is None or not (asked > 0 and awarded >= 0):
        return None
    return "not_supported" if awarded == 0 else "partially_supported" if awarded < asked else "supported"


def _target(s: str, parties: list[dict]) -> str:
    pays = compiled(c.PAYMENT).search(s)
    if pays:
        at, best = pays.start(), None
        for p in parties:
            if p["labor_role"] in ("employee", "employer"):
                # the last place of the name that begins before the payment, or else the first after it
                where = s.rfind(p["name"], 0, at + len(p["name"]))
                where = s.find(p["name"], at) if where < 0 else where
                if where >= 0 and (best is None or abs(at - where) < best[0]):
                    best = abs(at - where), p["roles"]
        if best:
            return next((r for r in c.BENEFICIARY if r in best[1]), "unknown")
    if has(s, c.AGAINST_FIRM):
        firm = next((p["roles"] for p in parties if p["labor_role"] == "employer" and any(r in p["roles"] for r in ("plaintiff", "appellant", "applicant"))), ())
        return "appellant" if "appellant" in firm else "plaintiff"
    return first_name(s, c.TARGETS, "unknown")


@lru_cache(KEPT)
def _clause(s: str) -> tuple[str, str | None, float | None, float | None]:
    """What a clause says by itself: action, type, asked, awarded."""
    confirms = has(s, c.CONFIRMS)
    kind = None
    for r in c.CLAIM_RULES:
        if in_context(s, r) or (confirms and r.type == c.CONFIRMATION):
            kind = r.type
            break
    action = first_name(s, c.ACTIONS, "unclear")
    awarded = 0.0 if action == "reject" else number(s, c.AWARDED)
    return action, kind, number(s, c.ASKED), number(s) if awarded is None and action == "pay" else awarded


def orders(decision: str | None, parties: list[dict]) -> list[dict]:
    """pos, source, action, target, type, carried, asked, awarded of the clauses of a decision that order something or name a claim.

    A clause that names no claim goes on with the one before it, if that names
    one and the clause isn't about appeal, the earlier judgment or other claims.
    """
    out: list[dict] = []
    clauses = [s for s in map(strip, compiled(c.CLAUSES).split(decision or "")) if s]
    for pos, s in enumerate(clauses):
        action, kind, asked, awarded = _clause(s)
        if action == "unclear" and kind is None:
            continue
        inherited = out[-1]["type"] if out and kind is None and action != "unclear" and not has(s, c.NOT_CONTINUED) else None
        out.append({"pos": pos, "source": s, "action": action, "target": _target(s, parties), "type": kind if inherited is None else inherited, "carried": inherited is not None, "asked": asked, "awarded": awarded})
    return out


def _taken(text: str, scope: str) -> list[c.ClaimRule]:
    """The rules whose claims a text makes, in order."""
    out = []
    for rule in c.CLAIM_RULES:
        if in_context(text, rule) and (not rule.from_request or in_context(scope, rule)):
            for w in rule.words:
                text = text.replace(w, "")
            out.append(rule)
    return out


_NO_SOURCE = ("", "unknown", "unknown")
_remembered = lambda pattern: lru_cache(KEPT)(lambda s: has(s, pattern))
_reasons, _arbitrates, _appeals, _asks_appeal, _states, _does_not_state = map(_remembered, (c.REASONING_MARK, c.ARBITRATION_MARK, c.APPEAL_MARK, c.APPEAL_ASKED, c.APPEAL_STATED, c.APPEAL_NOT_STATED))
_counters, _of_appeal, _procedural, _not_generic, _in_full = map(_remembered, (c.COUNTER_MARK, c.APPEAL_BASIS, c.PROCEDURAL_MARK, c.NOT_GENERIC, "全部|全额"))


def _pick(text: str, rule: c.ClaimRule, usable: Callable[[str], bool]) -> str | None:
    """The first fragment with a word of the rule that is usable; None without one, or where the text lacks the rule's context."""
    words = rule.words
    if not has_word(text, words) or (rule.context and not in_context(text, rule)):
        return None
    for s in fragments(text):
        if has_word(s, words) and is_request(s, words) and usable(s):
            return s
    return None


def done(order: dict) -> bool:
    return order["action"] in ("support", "pay")


def claims(text: str, request: str | None, known: dict, parts: Sections, ordered: list[dict]) -> list[dict]:
    """id, name, type, claimant_role, claimant_party, basis, outcome, source_kind, source_field, source, asked, awarded, orders (their places in ``orders``) of each claim.

    ``request`` is the text of the requests where a source has it by itself,
    ``known`` what ``parties.of_text`` and ``ordered`` what ``orders`` gives.
    A judgment without a known claim has one general claim, and an appeal that no
    claim stands for one of its own.
    """
    request, decision = request or "", parts["decision"] or ""
    until, scope = text[: _before_last(text, decision)], before_disposition(text, decision)
    ps, applicant, employee, employer = known["parties"], known["applicant_role"], known["employee"], known["employer"]
    appealed = applicant == "employer" or any(p["labor_role"] == "employer" and "appellant" in p["roles"] for p in ps)
    maintained = has(decision, "维持原判|维持原裁决")
    employees, firms = ("plaintiff", "appellee", "defendant"), ("appellant", "plaintiff", "applicant")

    def from_sections(rule: c.ClaimRule) -> tuple[str, str, str]:
        """Where the request stands: in its own text, the applicant's, the respondent's, or anywhere before the decision."""
        reasoned = lambda s: not _reasons(s)
        own = lambda s, kind: "arbitration_request" if _arbitrates(s) else "appeal_request" if _appeals(s) else kind
        if (s := _pick(request, rule, reasoned)) is not None:
            return s, own(s, "litigation_request"), "ssjl"
        mine = parts["applicant"] or ""
        if (s := _pick(mine, rule, reasoned)) is not None:
            return s, own(s, "appeal_request" if has(mine, c.APPEAL_SECTION) else "arbitration_request" if has(mine, c.ARBITRATION_SECTION) else "litigation_request"), "fbqw"
        if (s := _pick(parts["respondent"] or "", rule, reasoned)) is not None:
            return s, own(s, "party_statement"), "fbqw"
        if (s := _pick(until, rule, reasoned)) is not None:
            return s, "arbitration_request" if "仲裁" in s else "appeal_request" if "上诉" in s else "litigation_request", "fbqw"
        return _NO_SOURCE

    def underlying(rule: c.ClaimRule) -> tuple[str, str, str]:
        """The request that an appeal is about: never a fragment of the appeal itself."""
        for where, field in ((request, "ssjl"), (scope, "fbqw")):
            if (s := _pick(where, rule, lambda s: not _appeals(s))) is not None:
                return s, "arbitration_request" if _arbitrates(s) else "litigation_request", field
        return _NO_SOURCE

    def of_appeal(rule: c.ClaimRule) -> tuple[str, str, str]:
        if not appealed:
            return _NO_SOURCE
        own = parts["applicant"] or scope
        s = None
        if employer is not None and employee != "" and employee is not None:
            s = _pick(own, rule, lambda s: _asks_appeal(s) and employer in s and employee not in s)
        s = _pick(own, rule, _asks_appeal) if s is None else s
        return _NO_SOURCE if s is None else (s, "appeal_request", "fbqw")

    def states_appeal(rule: c.ClaimRule) -> bool:
        return appealed and has_word(scope, rule.words) and any(has_word(s, rule.words) and (employer is None or employer in s) and _states(s) and not _does_not_state(s) for s in fragments(scope))

    def of_rule(rule: c.ClaimRule) -> list[dict]:
        source = from_sections(rule)
        if source[1] == "appeal_request" and appealed:
            under = underlying(rule)
            source = under if under[0] else source
        s = source[0]
        # who asks for it, and on what basis
        counter = _counters(s)
        appeal, application = _of_appeal(s), "申请人" in s and not counter
        person, firm = employee is not None and employee in s, employer is not None and employer in s
        basis = "counterclaim" if counter else "appeal_request" if appeal else "application" if application else "original_claim"
        if counter:
            role = {"employee": "employer", "employer": "employee"}.get(applicant, "unknown")
        else:
            role = "employee" if person and not firm else "employer" if firm and not person else applicant
        sides = ("counterclaimant", "defendant", "respondent", "appellee") if counter else ("appellant",) if appeal else ("applicant",) if application else ("plaintiff",)
        own = [o for o in ordered if o["type"] == rule.type]
        # a claim that the orders give to the employee is the employee's, whoever is named first
        his = appealed and source[1] == "arbitration_request" and basis == "original_claim"
        if not his and applicant == "employer":
            to_employee = lambda o: o["target"] in employees
            both = any(map(done, own)) and any(map(to_employee, own))
            his = (
                (both and (s == "" or has(s, "被告|被上诉人"))) or (rule.type == "unpaid_remuneration" and any(done(o) and to_employee(o) for o in own))
                or (s == "" and rule.type == c.CONFIRMATION and maintained and any(o["action"] == "support" for o in own))
            )
        role, sides = ("employee", employees) if his else (role, sides)
        party = party_id(ps, role, sides)
        # what became of it
        applied = own or [o for o in ordered if o["type"] is None and o["target"] in ("plaintiff", "appellant") and not _not_generic(o["source"])]
        gives, rejects = any(map(done, applied)), any(o["action"] == "reject" for o in applied)
        with_amount = [o for o in own if o["awarded"] is not None]
        first = with_amount[0] if with_amount else None
        asked = None
        if rule.type != c.CONFIRMATION:
            asked = amount_near(s, rule.words)
            asked = next((o["asked"] for o in own if o["asked"] is not None), None) if asked is None else asked
        awarded = first["awarded"] if first else None
        one_amount = len(with_amount) == 1 and amount_count(first["source"]) <= 1
        if rejects:
            outcome = "partially_supported" if gives else "not_supported"
        elif gives and any(_in_full(o["source"]) for o in applied):
            outcome = "supported"
        else:
            outcome = (_by_amounts(asked, awarded) if one_amount else None) or ("supported" if gives else "unclear")
        if (
            outcome == "supported" and one_amount and rule.type in c.MONETARY and role in ("employee", "employer") and asked is not None and asked > awarded > 0 and done(first) and first["target"] != "unknown"
            and same_party(ps, role, party, first["target"])
        ):
            outcome = "partially_supported"  # more asked than awarded to this very claimant, by one order
        out = [_row(rule.name, rule.type, role, party, basis, outcome, source, asked, awarded, [o["pos"] for o in own])]
        # an appeal of the employer's is a claim of its own, which never takes over the employee's words
        if role != "employer" and appealed:
            text_, _, field = of_appeal(rule)
            if text_ != s and (text_ != "" or states_appeal(rule)):
                asked = amount_near(text_, rule.words) if text_ else None
                out.append(_row(rule.name, rule.type, "employer", party_id(ps, "employer", firms), "appeal_request", "unclear", (text_, "appeal_request", field), asked, None, []))
        return out

    def procedural() -> str:
        return next((s for s in fragments(text) if _procedural(s) and is_request(s)), "")

    def fallback() -> dict:
        mine = [o for o in ordered if o["type"] is None and o["target"] in ("plaintiff", "appellant")]
        yes, no = any(o["action"] == "support" for o in mine), any(o["action"] == "reject" for o in mine)
        appeal, s = has(text, "上诉人|上诉请求|撤销原判"), procedural()
        outcome = "partially_supported" if yes and no else "supported" if yes else "not_supported" if no else "unclear"
        source = (s, "appeal_request" if "上诉" in s else "inferred", "fbqw") if s else _NO_SOURCE
        party = party_id(ps, applicant, ("plaintiff", "applicant", "appellant"))
        return _row(c.GENERAL_CLAIM, "procedural_appeal" if appeal else "general_labor_claim", applicant, party, "appeal_request" if appeal else "unknown", outcome, source, None, None, [])

    def appeal_row() -> dict:
        rejected = next((o for o in ordered if o["target"] == "appellant" and o["action"] == "reject"), None)
        s = procedural()
        return _row(c.APPEAL_CLAIM, "procedural_appeal", applicant, party_id(ps, applicant, firms), "appeal_request", "not_supported" if rejected else "unclear", (s, "appeal_request", "fbqw") if s else _NO_SOURCE, None, None, [rejected["pos"]] if rejected else [])

    out = [row for rule in _taken(text, scope) for row in of_rule(rule)] or [fallback()]
    if has(text, "上诉人|上诉请求") and all(x["basis"] != "appeal_request" for x in out):
        out.append(appeal_row())
    for i, x in enumerate(out):
        x["id"] = f"claim_{i + 1}"
    return out


def same_party(parties: list[dict], labor_role: str, party: str | None, target: str | None) -> bool:
    """Whether one claimant there is, and this is the one party that an order is addressed to."""
    claimants = [p["id"] for p in parties if p["labor_role"] == labor_role and (party is None or p["id"] == party)]
    gaining = [p["id"] for p in parties if target in p["roles"]]
    return len(claimants) == len(gaining) == 1 and claimants == gaining


def _row(name, kind, role, party, basis, outcome, source, asked, awarded, places) -> dict:
    text, source_kind, field = source
    return {"name": name, "type": kind, "claimant_role": role, "claimant_party": party, "basis": basis, "outcome": outcome, "source_kind": source_kind, "source_field": field, "source": text, "asked": asked, "awarded": awarded, "orders": places}
