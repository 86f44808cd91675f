"""Routing of candidates as an ordered fold, and every reason that a candidate alone can have."""

import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import routing

SCHEMA = "case_id string, fragment string, n int, claim_ids array<string>, treatment string, confidence double, reasons array<string>, extra string"


def routed(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return [(r["route"], list(r["reasons"])) for r in sorted(routing.route(df, group=["case_id", "fragment"], order=["n"]).collect(), key=lambda r: (r["case_id"] or "", r["fragment"] or "", r["n"]))]


def row(n, ids, treatment, confidence=0.9, own=(), case="a", fragment="f"):
    return (case, fragment, n, ids, treatment, confidence, list(own), "x")


def brute(rows):
    out, seen = [], []
    for case, fragment, _, ids, treatment, confidence, own, _ in rows:
        why = list(own)
        if any((c, f) == (case, fragment) and set(i or []) & set(ids or []) and t != treatment for c, f, i, t in seen):
            why.append(routing.CONFLICT)
        if why or confidence < routing.REVIEW:
            out.append(("rejected", why or [routing.BELOW]))
        else:
            out.append(("accepted", []) if confidence >= routing.ACCEPT else ("human_review", [routing.NEEDS_REVIEW]))
            seen.append((case, fragment, ids, treatment))
    return out


def test_a_rejected_candidate_is_held_against_nobody(spark):
    a, b = (["c1"], "accepted"), (["c1"], "rejected")
    assert [r for r, _ in routed(spark, [row(0, *a), row(1, *b), row(2, *a)])] == ["accepted", "rejected", "accepted"]
    assert [r for r, _ in routed(spark, [row(0, *b, own=["x"]), row(1, *a), row(2, *b)])] == ["rejected", "accepted", "rejected"]


def test_reviewed_ones_count_and_all_earlier_ones(spark):
    rows = [row(0, ["c1"], "accepted", 0.75), row(1, ["c2"], "rejected"), row(2, ["c3"], "accepted"), row(3, ["c1", "c3"], "rejected"), row(4, ["c1", "c4"], "accepted"), row(5, ["c4"], "unclear")]
    assert routed(spark, rows) == [("human_review", [routing.NEEDS_REVIEW]), ("accepted", []), ("accepted", []), ("rejected", [routing.CONFLICT]), ("accepted", []), ("rejected", [routing.CONFLICT])]


def test_random_groups(spark):
    rng = random.Random(3)
    rows = []
    for case in ("a", "b", None):
        for fragment in ("f", "g", None):
            for n in range(60):
                rows.append(row(n, rng.sample(["c1", "c2", "c3", "c4"], rng.randint(0, 2)), rng.choice(["accepted", "rejected", "unclear"]), rng.choice([0.6, 0.75, 0.9]), rng.choice([(), (), ("bad",)]), case, fragment))
    rows.sort(key=lambda r: (r[0] or "", r[1] or "", r[2]))
    assert routed(spark, rows) == brute(rows)
    assert routed(spark, []) == []


GOOD = {
    "fragment_found": True, "source_text": "第一项予以支持", "fragment_text": "第一项予以支持", "method": "llm", "claim_ids": ["c1"], "known_ids": ["c1", "c2"], "allowed_ids": None, "confidence": 0.9, "treatment": "accepted",
    "reasoning": "ordinal_reference", "order_action": None, "party": None, "claim_parties": ["p1"], "provenance": True, "handled_ids": [],
}
WRONG = [
    ({}, []),
    ({"fragment_found": False, "fragment_text": None}, ["fragment_not_found"]),
    ({"method": "ordinal"}, ["invalid_resolution_method"]),
    ({"claim_ids": [], "fragment_text": "该项请求", "source_text": "该项请求"}, ["empty_referenced_claim_ids"]),
    ({"claim_ids": None, "fragment_text": "该项请求", "source_text": "该项请求"}, ["empty_referenced_claim_ids"]),
    ({"claim_ids": ["c1", " "], "fragment_text": "x", "source_text": "x"}, ["blank_claim_id", "claim_id_not_found"]),
    ({"claim_ids": ["c1", "c1"], "fragment_text": "x", "source_text": "x"}, ["duplicate_claim_id"]),
    ({"claim_ids": ["c9"], "fragment_text": "x", "source_text": "x"}, ["claim_id_not_found"]),
    ({"source_text": "第一项"}, ["source_text_not_exact"]),
    ({"allowed_ids": ["c2"]}, ["claim_outside_fragment_candidates"]),
    ({"confidence": 1.5}, ["confidence_out_of_range"]),
    ({"confidence": float("nan")}, ["confidence_out_of_range"]),
    ({"confidence": None}, ["confidence_out_of_range"]),
    ({"treatment": "maybe", "fragment_text": "x", "source_text": "x"}, ["invalid_court_treatment"]),
    ({"reasoning": "guess"}, ["invalid_reasoning_type"]),
    ({"order_action": "reject"}, ["court_treatment_conflicts_with_deterministic_action"]),
    ({"order_action": "pay"}, []),
    ({"party": "p2"}, ["unrelated_claimant_party"]),
    ({"party": "p1"}, []),
    ({"provenance": None}, ["invalid_provenance"]),
    ({"treatment": "rejected"}, ["conflicts_with_deterministic_ordinal_resolution"]),
    ({"claim_ids": ["c2"]}, ["conflicts_with_deterministic_ordinal_resolution"]),
    ({"fragment_text": "第五项予以支持", "source_text": "第五项予以支持"}, ["ordinal_out_of_range"]),
]


def test_reasons(spark):
    text, ids = "string", "array<string>"
    kinds = dict.fromkeys(GOOD, text) | {"fragment_found": "boolean", "provenance": "boolean", "confidence": "double"} | dict.fromkeys(("claim_ids", "known_ids", "allowed_ids", "claim_parties", "handled_ids"), ids)
    df = spark.createDataFrame([(i, *(GOOD | more).values()) for i, (more, _) in enumerate(WRONG)], "i int, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))
    got = {r["i"]: list(r["r"]) for r in df.select("i", routing.reasons({k: F.col(k) for k in GOOD}).alias("r")).collect()}
    assert [got[i] for i in range(len(WRONG))] == [want for _, want in WRONG]


@pytest.mark.parametrize("confidence,want", [(0.8, "accepted"), (0.79, "human_review"), (0.7, "human_review"), (0.69, "rejected"), (None, "rejected")])
def test_thresholds(spark, confidence, want):
    assert [r for r, _ in routed(spark, [row(0, ["c1"], "accepted", confidence)])] == [want]
