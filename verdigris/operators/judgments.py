"""Court judgments read into parties, orders, claims, references and outcomes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import claims as cl
from verdigris.functions import court_tables as c
from verdigris.functions import diagnoses as dg
from verdigris.functions import parties as pt
from verdigris.functions.fragments import strip
from verdigris.functions.references import resolved

#: What can be read of a text.  Each needs those before it, but for parts.
FOUND = {"known": pt.KNOWN, "parts": cl.SECTIONS, "orders": cl.ORDERS, "claims": cl.CLAIMS, "references": dg.REFERENCES, "outcomes": dg.OUTCOMES, "diagnostics": dg.DIAGNOSES}
#: Texts whose results a worker keeps: short ones without amounts come again and again.
TEXTS_KEPT = 2048


def of_text(text: str | None, title: str | None, request: str | None, wanted: tuple[str, ...]) -> dict:
    """What is found in one text, as far as wanted; a null text is an empty one."""
    text = strip(text or "")
    parts, known = cl.Sections(text), pt.of_text(text, title)
    out = {"known": known}
    if any(k not in ("known", "parts") for k in wanted):
        decision = parts["decision"]
        orders = out["orders"] = cl.orders(decision, known["parties"])
        if any(k not in ("known", "parts", "orders") for k in wanted):
            claims = out["claims"] = cl.claims(text, request, known, parts, orders)
            if "references" in wanted:
                out["references"] = dg.open_references(decision, claims)
            if "outcomes" in wanted or "diagnostics" in wanted:
                outcomes = out["outcomes"] = dg.party_outcomes(known, claims, orders)
                if "diagnostics" in wanted:
                    out["diagnostics"] = dg.of_case(decision, claims, orders, known, outcomes)
    if "parts" in wanted:
        out["parts"] = parts.all()
    return {k: out[k] for k in wanted}


def read(df: DataFrame, wanted: tuple[str, ...] = tuple(FOUND)) -> DataFrame:
    """A table of texts with what the rules find in them, all in the row: nothing is shuffled.

    The table has text and may have title and request (the requests, where a source
    has them by themselves).  New columns: known (parties), parts (sections),
    orders, claims, references (what is left to a resolver), outcomes, diagnostics,
    or those that are wanted; the work for others is left out.  A null text is an
    empty one.
    """
    kind = "struct<" + ",".join(f"{k}:{FOUND[k]}" for k in wanted) + ">"
    arrow = pt.arrow_type(kind)
    args = [F.col(k) if k in df.columns else F.lit(None).cast("string") for k in ("text", "title", "request")]

    @F.arrow_udf(kind)
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kept = lru_cache(TEXTS_KEPT)(of_text)
        for columns in batches:
            yield pa.array([kept(*row, wanted) for row in zip(*(x.to_pylist() for x in columns), strict=True)], arrow)

    # not deterministic, or else a filter on what is found would be pushed before it with all the work a second time
    rows = df.withColumn("_found", found.asNondeterministic()(*args))
    return rows.select(*(k for k in df.columns if k not in wanted), *(F.col(f"_found.{k}").alias(k) for k in wanted))


def resolve_references(cases: DataFrame) -> DataFrame:
    """case_id, source, status, reason and the candidates (claim_ids, treatment, action, reasoning, method) of each clause of a decision that refers to claims by number.

    cases as ``read`` gives them; a clause comes after those before it, whose
    orders have dealt with their claims.
    """
    clause = F.filter(F.transform(F.split(F.coalesce("parts.decision", F.lit("")), "[。；;\\n\\r]+"), lambda s: F.btrim(s, F.lit(c.BLANKS))), lambda s: s.rlike("第[一二两三四五六七八九十百〇零\\d]|前[一二两三四五六七八九十\\d]+项|其余|上述|前述|该项请求"))
    ids = F.transform("claims", lambda x: x["id"])
    handled = F.transform(F.filter("claims", lambda x: F.size(x["orders"]) > 0), lambda x: x["id"])
    rows = cases.select("case_id", F.posexplode(clause).alias("pos", "source"), ids.alias("ids"), handled.alias("handled"))
    return rows.select("case_id", "pos", "source", resolved(F.col("source"), F.col("ids"), F.col("handled")).alias("r")).select("case_id", "pos", "source", "r.*")
