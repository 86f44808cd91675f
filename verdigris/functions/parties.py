"""Who stands where in a court judgment: party names, their side in the procedure and at work.

Everything is read from the text's head, the part before facts, pleas or reasons
begin; later text names parties in passing and is no source of them.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from verdigris.functions import court_tables as c
from verdigris.functions.fragments import KEPT, compiled, found, has

PARTIES = "array<struct<id:string,name:string,labor_role:string,roles:array<string>>>"
KNOWN = f"struct<employee:string,employer:string,applicant_role:string,confidence:double,parties:{PARTIES}>"


def head(text: str) -> str:
    """The part of a text in which parties are named."""
    text = text.lstrip("﻿")
    m = compiled(c.IDENTITY_ENDS).search(text)
    return text[: m.start()] if m else text[: c.IDENTITY_LENGTH]


@lru_cache(KEPT)
def clean_name(name: str) -> str:
    """A name without what is in brackets or after a mark, and without blanks."""
    name = compiled("[,，。、：:].*$").sub("", compiled("[（\\(].*?[）\\)]").sub("", name))
    return compiled("[\\s 　]+").sub("", name)


@lru_cache(KEPT)
def _is_name(name: str) -> bool:
    if name == "" or len(name) > 60 or has(name, "[！!？?]") or has(name, c.STATEMENT) or has(name, c.NO_NAME):
        return False
    return has(name, c.ORGANISATION) or (has(name, c.PERSON) and not has(name, c.NO_NAME_END))


@lru_cache(KEPT)
def _is_firm(name: str | None) -> bool:
    return name is not None and has(name, c.FIRM)


@lru_cache(KEPT)
def _is_person(name: str | None) -> bool:
    if name is None or has(name, c.FIRM):
        return False
    han = compiled("[^一-龥]").sub("", name)
    return 2 <= len(han) <= 5 and not has(han, c.NO_PERSON)


def candidates(start: str) -> list[tuple[str, str]]:
    """(label, name) of what the head names as a party, in order."""
    return [(label, name) for label, raw in compiled(c.PARTY).findall(start) if _is_name(name := clean_name(raw))]


def of_text(text: str, title: str | None) -> dict:
    """employee, employer, applicant_role, confidence and parties (id, name, labor_role, roles) of a text.

    * A title counts only where a side isn't named in the text.
    * A name that comes twice is one party with all its roles, in order of mention.
    """
    start = head(text)
    named = candidates(start)
    firsts, seconds = ([name for label, name in named if label in side] for side in (c.FIRST_SIDE, c.SECOND_SIDE))
    a, b = next(iter(firsts), None), next(iter(seconds), None)
    person, firm = _is_person, _is_firm
    by_title = None
    if title is not None and (a is None or b is None):
        left, right = (None if x is None else clean_name(x) for x in (found(title, c.TITLE, 1), found(title, c.TITLE, 2)))
        by_title = (left, right) if person(left) and firm(right) else (right, left) if firm(left) and person(right) else None
    # the ladder of what the two sides are: employee, employer, applicant's role, confidence
    employee, employer, role, confidence = None, None, "unknown", 0.85 if by_title else 0.5
    if a is not None and b is not None:
        if person(a) and firm(b):
            employee, employer, role, confidence = a, b, "employee", 0.95
        elif firm(a) and person(b):
            employee, employer, role, confidence = b, a, "employer", 0.95
        elif firm(a) and firm(b):
            worker = found(text, c.WORKER)
            employee, employer, role, confidence = (worker, a, "employer", 0.75) if person(worker) else (None, a, "unknown", 0.4)
        elif person(a) and person(b):
            employee, employer, role, confidence = a, b, "employee", 0.6
    elif a is not None:
        employee, employer, role, confidence = (None, a, "employer", 0.5) if firm(a) else (a, None, "employee", 0.5)
    if by_title:
        employee, employer = by_title[0] if employee is None else employee, by_title[1] if employer is None else employer
    sided = firsts + seconds
    employee = next(filter(person, sided), None) if employee is None else employee
    employer = next(filter(firm, sided), None) if employer is None else employer
    # what the text says in passing, where a side is still open
    in_passing = found(text, c.WORKER_IN_CONTEXT) if employee is None else None
    in_passing = in_passing if person(in_passing) else None
    firm_in_passing = found(text, c.FIRM_IN_CONTEXT) if employer is None else None
    if in_passing is not None or firm_in_passing is not None:
        confidence = max(confidence, 0.7)
    employee, employer = in_passing if employee is None else employee, firm_in_passing if employer is None else employer
    return {"employee": employee, "employer": employer, "applicant_role": role, "confidence": confidence, "parties": _parties(named, employee, employer, has(start, c.COUNTERCLAIM))}


def _parties(named: list[tuple[str, str]], employee: str | None, employer: str | None, countered: bool) -> list[dict]:
    roles: dict[str, list[str]] = {}
    for label, name in named:
        own, role = roles.setdefault(name, []), c.PROCEDURAL_ROLES.get(label, "unknown")
        if role not in own:
            own.append(role)

    def side(name: str) -> str:
        return "employee" if name == employee else "employer" if name == employer else "other" if roles[name][0] == "third_party" else "unknown"

    out = [{"id": f"party_{i + 1}", "name": name, "labor_role": side(name), "roles": own} for i, (name, own) in enumerate(roles.items())]
    if countered and (answers := next((p for p in out if "defendant" in p["roles"] or "respondent" in p["roles"]), None)):
        answers["roles"] += [r for r in ("counterclaimPlaintiff", "counterclaimant") if r not in answers["roles"]]
    return out


def party_id(parties: list[dict], labor_role: str, roles: tuple[str, ...]) -> str | None:
    """The first party of a side with one of the procedural roles, or the first of the side."""
    mine = [p for p in parties if p["labor_role"] == labor_role]
    best = (p for p in mine if any(r in p["roles"] for r in roles))
    return next(best, mine[0])["id"] if mine else None


def arrow_type(ddl: str) -> pa.DataType:
    """The Arrow type of a Spark type; for the driver, as only a session reads DDL."""
    return to_arrow_type(DataType.fromDDL(ddl))


def recognised(text: Column, title: Column) -> Column:
    """A struct of employee, employer, applicant_role, confidence and parties; a null text has no parties."""
    kind = arrow_type(KNOWN)

    @F.arrow_udf(KNOWN)
    def known(texts: pa.Array, titles: pa.Array) -> pa.Array:
        return pa.array([of_text(x or "", y) for x, y in zip(texts.to_pylist(), titles.to_pylist(), strict=True)], kind)

    return known(text, title)
