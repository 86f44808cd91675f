"""References to claims by their number: which claims a clause means, and what it says of them.

A clause is cut at each reference; what lies between two marks about a reference
says how the court treats it.  A list of numbers is a set of claims, 'the first
so many' a prefix of them, 'the remaining' what no earlier order has dealt with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions import court_tables as c
from verdigris.functions.rules import first_name, let

_CUT = "\u0001"
_CANDIDATE = "array<struct<claim_ids:array<string>,treatment:string,action:string,reasoning:string,method:string>>"


def ordinal(raw: Column) -> Column:
    """The number that a numeral stands for, in digits or in Chinese up to 99; null for any other."""
    digits = F.create_map(*(F.lit(x) for pair in c.DIGITS.items() for x in pair))
    ten = F.position(F.lit("十"), raw)
    tens = F.when(ten == 1, F.lit(1)).otherwise(digits[F.substring(raw, ten - 1, F.lit(1))])
    units = F.when(ten == F.length(raw), F.lit(0)).otherwise(digits[F.substring(raw, ten + 1, F.lit(1))])
    return F.when(raw.rlike("^\\d+$"), raw.try_cast("int")).when(raw == "十", F.lit(10)).when(ten > 0, tens * 10 + units).when(F.length(raw) == 1, digits[raw])


def _marked(source: Column, pattern: str) -> Column:
    """An array of (numerals, clause) for each reference of a kind: what its group has, and the text about it up to the next marks."""
    pieces = F.split(F.regexp_replace(F.replace(source, F.lit(_CUT), F.lit("")), f"(?:{pattern})", f"{_CUT}$0{_CUT}"), _CUT)

    def about(ps: Column) -> Column:
        def one(i: Column) -> Column:  # pieces 2, 4, ... are the references
            before = F.regexp_extract(F.array_join(F.slice(ps, F.lit(1), i - 1), ""), "[^。；;，,]*$", 0)
            after = F.regexp_extract(F.array_join(F.slice(ps, i + 1, F.size(ps)), ""), "^[^。；;，,]*", 0)
            here = F.element_at(ps, i)
            return F.struct(F.regexp_extract(here, pattern, 1).alias("numerals"), F.concat(before, here, after).alias("clause"))

        return F.transform(F.when(F.size(ps) > 1, F.sequence(F.lit(2), F.size(ps) - 1, F.lit(2))).otherwise(F.array().cast("array<int>")), one)

    return let(pieces, about)


def _candidate(ids: Column, clause: Column, reasoning: Column, method: str) -> Column:
    action = F.nullif(first_name(clause, c.REFERENCE_ACTIONS, F.lit("")), F.lit(""))
    return F.struct(ids.alias("claim_ids"), first_name(clause, c.TREATMENTS, F.lit("unclear")).alias("treatment"), action.alias("action"), reasoning.alias("reasoning"), F.lit(method).alias("method"))


def resolved(source: Column, claim_ids: Column, handled: Column) -> Column:
    """A struct of status, reason and candidates (claim_ids, treatment, action, reasoning, method) for a clause.

    ``claim_ids`` has the claims in order, ``handled`` those that earlier orders
    have dealt with.  One number that no claim has leaves the whole clause
    unresolved; a clause without any reference that a rule can follow does too.
    """
    base = F.struct(source.alias("source"), F.coalesce(claim_ids, F.array().cast("array<string>")).alias("ids"), F.coalesce(handled, F.array().cast("array<string>")).alias("handled"))
    return let(base, lambda b: _resolved(b["source"], b["ids"], b["handled"]))


def _resolved(source: Column, claim_ids: Column, handled: Column) -> Column:
    several, earlier = F.lit("multi_claim_reference"), F.when(source.rlike(c.EARLIER_JUDGMENT), "appeal_mapping").otherwise("ordinal_reference")

    def numbered(m: Column) -> Column:
        ns = F.transform(F.split(m["numerals"], c.NUMBER_JOINTS), ordinal)
        return F.struct(ns.alias("ns"), m["clause"].alias("clause"), F.when(F.size(ns) > 1, several).otherwise(earlier).alias("reasoning"))

    def leading(m: Column) -> Column:
        n = ordinal(m["numerals"])
        ns = F.when(n.between(1, F.size(claim_ids)), F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array(n))
        return F.struct(ns.alias("ns"), m["clause"].alias("clause"), several.alias("reasoning"))

    found = F.concat(F.transform(_marked(source, c.NUMBERED), numbered), F.transform(_marked(source, c.LEADING), leading))

    def decided(all_: Column) -> Column:
        outside = F.exists(all_, lambda m: F.exists(m["ns"], lambda n: n.isNull() | (n < 1) | (n > F.size(claim_ids))))
        by_number = F.transform(all_, lambda m: _candidate(F.transform(m["ns"], lambda n: F.get(claim_ids, n - 1)), m["clause"], m["reasoning"], "ordinal"))
        rest = F.filter(claim_ids, lambda x: ~F.array_contains(handled, x))
        remaining, known = source.rlike(c.REMAINING), (F.size(handled) > 0) & (F.size(rest) > 0)
        reason = (
            F.when(outside, "ordinal_out_of_range").when(F.size(all_) > 0, "deterministic_ordinal_match").when(remaining & known, "remaining_claims_by_elimination")
            .when(remaining, "remaining_claims_without_prior_mapping").otherwise("non_deterministic_anaphora")
        )
        candidates = F.when(outside, F.array().cast(_CANDIDATE)).when(F.size(all_) > 0, by_number.cast(_CANDIDATE)).when(remaining & known, F.array(_candidate(rest, source, F.lit("remaining_claims"), "rule")).cast(_CANDIDATE)).otherwise(F.array().cast(_CANDIDATE))
        return F.struct(F.when(F.size(candidates) > 0, "resolved").otherwise("unresolved").alias("status"), reason.alias("reason"), candidates.alias("candidates"))

    return let(found, decided)
