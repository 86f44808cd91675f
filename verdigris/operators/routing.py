"""Candidates for open references: checked one by one, routed in order, each held against all before it that went through."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.references import resolved

#: Confidence from which a candidate is accepted, and from which a reviewer sees it.
ACCEPT, REVIEW = 0.80, 0.70
# What a candidate may say.
TREATMENTS = ("accepted", "partially_accepted", "rejected", "not_addressed", "unclear")
REASONINGS = ("ordinal_reference", "multi_claim_reference", "remaining_claims", "anaphora", "cross_sentence", "appeal_mapping", "other")
FITTING = {"reject": ("rejected",), "support": ("accepted",), "pay": ("accepted", "partially_accepted")}
CONFLICT, BELOW, NEEDS_REVIEW = "conflicts_with_existing_candidate", "confidence_below_rejection_threshold", "confidence_requires_human_review"


def reasons(c: dict[str, Column]) -> Column:
    """What is wrong with a candidate by itself, all of it, in a fixed order.

    Columns: fragment_found, source_text and fragment_text, method, claim_ids,
    known_ids (the case's claims in order), allowed_ids (of the fragment; null: all),
    confidence, treatment, reasoning, order_action (of the order with the same
    text; null: none), party and claim_parties (of the claims named), provenance
    (complete or not), handled_ids (claims that orders have dealt with).
    """
    ids = F.coalesce(c["claim_ids"], F.array().cast("array<string>"))
    exact = c["source_text"].eqNullSafe(c["fragment_text"])
    sure = F.coalesce((c["confidence"] >= 0) & (c["confidence"] <= 1), F.lit(False))  # not a number is neither
    misfit = F.lit(False)
    for action, fitting in FITTING.items():
        misfit = misfit | ((c["order_action"] == action) & ~F.coalesce(c["treatment"].isin(*fitting), F.lit(False)))
    by_rule = resolved(F.coalesce(c["fragment_text"], F.lit("")), c["known_ids"], c["handled_ids"])
    ruled = (by_rule["status"] == "resolved") & (by_rule["reason"] == "deterministic_ordinal_match")
    same = lambda x: (F.array_sort(x["claim_ids"]) == F.array_sort(ids)) & ((x["treatment"] == "unclear") | (x["treatment"] == c["treatment"]))
    checks = {
        "fragment_not_found": ~c["fragment_found"],
        "invalid_resolution_method": ~c["method"].eqNullSafe(F.lit("llm")),
        "empty_referenced_claim_ids": F.size(ids) == 0,
        "blank_claim_id": F.exists(ids, lambda x: F.coalesce(F.trim(x), F.lit("")) == ""),
        "duplicate_claim_id": F.size(F.array_distinct(ids)) != F.size(ids),
        "claim_id_not_found": F.exists(ids, lambda x: ~F.array_contains(c["known_ids"], F.coalesce(x, F.lit("")))),
        "source_text_not_exact": c["fragment_found"] & ~exact,
        "claim_outside_fragment_candidates": c["fragment_found"] & (F.size(c["allowed_ids"]) > 0) & F.exists(ids, lambda x: ~F.array_contains(c["allowed_ids"], F.coalesce(x, F.lit("")))),
        "confidence_out_of_range": ~sure | c["confidence"].isNull(),
        "invalid_court_treatment": ~F.coalesce(c["treatment"].isin(*TREATMENTS), F.lit(False)),
        "invalid_reasoning_type": ~F.coalesce(c["reasoning"].isin(*REASONINGS), F.lit(False)),
        "court_treatment_conflicts_with_deterministic_action": misfit,
        "unrelated_claimant_party": c["party"].isNotNull() & ~F.array_contains(F.coalesce(c["claim_parties"], F.array().cast("array<string>")), F.coalesce(c["party"], F.lit(""))),
        "invalid_provenance": ~F.coalesce(c["provenance"], F.lit(False)),
        "conflicts_with_deterministic_ordinal_resolution": c["fragment_found"] & ruled & ~F.exists(by_rule["candidates"], same),
        "ordinal_out_of_range": c["fragment_found"] & (by_rule["reason"] == "ordinal_out_of_range"),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items())))


def route(candidates: DataFrame, *, group: list[str], order: list[str], claims: str = "claim_ids", treatment: str = "treatment", confidence: str = "confidence", found: str = "reasons") -> DataFrame:
    """candidates with route (accepted, human_review, rejected) and reasons.

    Within a group (a fragment of a case) candidates come in order.  One without
    reasons of its own is held against *all* earlier ones that were accepted or
    sent to a reviewer: another treatment of a claim that one of them treats
    rejects it, and a rejected one is held against nobody.  A group streams
    through a task with one treatment for each claim in memory, however many
    candidates it has; Spark sorts.

    * Nulls in the group are a group of their own; a candidate without claims conflicts with none.
    * Candidates of equal order are taken by their claims, treatment and confidence.
    """
    columns = candidates.columns
    at = {c: columns.index(c) for c in (*group, claims, treatment, confidence, found)}
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns if c != found), "route string", f"`{found}` array<string>"])
    rest = [c for c in columns if c != found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, treated = None, {}
        for batch in batches:
            values = {c: batch.column(i).to_pylist() for c, i in at.items()}
            routes, why = [], []
            for k in range(batch.num_rows):
                if (key := tuple(values[g][k] for g in group)) != now:
                    now, treated = key, {}
                says, ids, sure = values[treatment][k], values[claims][k] or [], values[confidence][k]
                own = list(values[found][k] or [])
                if any(treated.get(x, says) != says for x in ids):
                    own.append(CONFLICT)
                if own or sure is None or sure < REVIEW:
                    routes.append("rejected")
                    why.append(own or [BELOW])
                    continue
                routes.append("accepted" if sure >= ACCEPT else "human_review")
                why.append([] if sure >= ACCEPT else [NEEDS_REVIEW])
                treated.update(dict.fromkeys(ids, says))
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in rest), pa.array(routes, pa.string()), pa.array(why, pa.list_(pa.string()))], names=[*rest, "route", found])

    # all of a group in one task, in order; what a task holds is a group's treatments
    dealt = candidates.repartition(*(F.col(g) for g in group)).sortWithinPartitions(*group, *order, claims, treatment, confidence)
    return dealt.mapInArrow(run, schema)
