"""Queries of runs, identities, candidates, reviews and their provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions import contracts, unicode
from verdigris.functions.claims import amount_outcome
from verdigris.functions.rates import merged_outcome, percent
from verdigris.operators import provenance as pv
from verdigris.operators import records as rec
from verdigris.operators import routing, stats
from verdigris.plans.records import RECORDS, records
from verdigris.plans.registry import query
from verdigris.sources.records import CLAIMS, PARSED, REVIEWS, claims, parsed, reviews
from verdigris.sources.tables import CASES, COUNTS, RATES, cases, table

_MERGED = "CASE WHEN bool_or({o} = 'partially_supported') OR (bool_or({o} = 'supported') AND bool_or({o} = 'not_supported')) THEN 'partially_supported' WHEN bool_or({o} = 'supported') THEN 'supported' WHEN bool_or({o} = 'not_supported') THEN 'not_supported' ELSE 'unclear' END"
_FILTER = "lambda x: x IS NOT NULL"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """A run for each customer over that customer's orders."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("kinds"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.sum("o_orderkey").alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("open"))


_RUNS = "runs AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds, min(o_orderkey) AS first, max(o_orderkey) AS last, sum(o_orderkey)::BIGINT AS total, count(*) FILTER (WHERE o_orderstatus = 'P') AS open FROM orders GROUP BY o_custkey)"


@query(
    "r06_run_lifecycle",
    "WITH s AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, lag(CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'completed' END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) SELECT status, before, before IS NULL OR (before = 'pending' AND status = 'running') OR (before = 'running' AND status = 'completed') AS allowed, count(*) AS n FROM s GROUP BY ALL",
)
def r06(spark: SparkSession, d: str) -> DataFrame:
    """Changes of status of runs, and which of them the life cycle allows."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", status.alias("status"))
    rows = rows.withColumn("before", F.lag("status").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    b, s = F.col("before"), F.col("status")
    allowed = b.isNull() | ((b == "pending") & (s == "running")) | ((b == "running") & (s == "completed"))
    return rows.groupBy("status", "before", allowed.alias("allowed")).agg(F.count("*").alias("n"))


@query("r07_provenance_diff", f"WITH {_RUNS}, b AS (SELECT o_custkey, n, kinds, first, CASE WHEN o_custkey % 3 = 0 THEN last + 1 ELSE last END AS last, total, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE open END AS open FROM runs) SELECT a.o_custkey, a.first IS DISTINCT FROM b.first OR a.last IS DISTINCT FROM b.last AS snapshot_changed, a.n IS DISTINCT FROM b.n AS sampling_changed, a.total IS DISTINCT FROM b.total AS input_changed, a.open IS DISTINCT FROM b.open AS semantic_changed FROM runs a JOIN b USING (o_custkey)")
def r07(spark: SparkSession, d: str) -> DataFrame:
    """What differs between two runs."""
    a = _runs(spark, d)
    b = a.withColumn("last", F.when(F.col("o_custkey") % 3 == 0, F.col("last") + 1).otherwise(F.col("last"))).withColumn("open", F.when(F.col("o_custkey") % 4 != 0, F.col("open")))
    return pv.changes(a, b, ["o_custkey"], {"snapshot_changed": ["first", "last"], "sampling_changed": ["n"], "input_changed": ["total"], "semantic_changed": ["open"]})


@query("r08_integrity", f"WITH {_RUNS} SELECT o_custkey, array_to_string(list_filter([CASE WHEN n > 15 THEN 'INPUT_CASE_COUNT_MISMATCH' END, CASE WHEN kinds < n THEN 'DUPLICATE_INPUT_CASE_IDS' END, CASE WHEN open > 0 THEN 'SNAPSHOT_NOT_COMPLETE' END, CASE WHEN last - first > 30000 THEN 'SAMPLE_OUTSIDE_SNAPSHOT' END, CASE WHEN total % 2 = 1 THEN 'ANALYSIS_PROVENANCE_HASH_MISMATCH' END], {_FILTER}), ',') AS issues FROM runs")
def r08(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a run against its snapshot, all of it."""
    c = F.col
    found = pv.issues(INPUT_CASE_COUNT_MISMATCH=c("n") > 15, DUPLICATE_INPUT_CASE_IDS=c("kinds") < c("n"), SNAPSHOT_NOT_COMPLETE=c("open") > 0, SAMPLE_OUTSIDE_SNAPSHOT=c("last") - c("first") > 30000, ANALYSIS_PROVENANCE_HASH_MISMATCH=c("total") % 2 == 1)
    return _runs(spark, d).select("o_custkey", F.array_join(found, ",").alias("issues"))


@query("r09_gated_execution", f"WITH {CASES}, s AS (SELECT segment, {COUNTS} FROM cases WHERE outcome <> 'unclear' AND amount <= 450000 GROUP BY segment) SELECT *, {RATES} FROM s")
def r09(spark: SparkSession, d: str) -> DataFrame:
    """An analysis of admitted records alone."""
    reasons = pv.issues(critical_outcome_unclear=F.col("outcome") == "unclear", audit_failed=F.col("amount") > 450000)
    return pv.gated(cases(spark, d), reasons, lambda df: stats.outcome_stats(df, "outcome", "segment"))[0]


def _identity() -> Column:
    c = F.col
    return pv.chain(c("case_id"), c("claim_id"), c("kind"), c("role"), F.coalesce(c("asked").cast("long").cast("string"), F.lit("")))


_IDENTITY = """sha256('["' || case_id || '","' || claim_id || '","' || kind || '","' || role || '","' || coalesce(trunc(asked)::BIGINT::VARCHAR, '') || '"]')"""
_STORED = f"CASE WHEN case_id % 5 = 0 THEN NULL WHEN case_id % 5 = 1 THEN 'old' ELSE {_IDENTITY} END"


@query("r10_claim_identity", f"WITH {CLAIMS}, i AS (SELECT case_id, claim_id, {_IDENTITY} AS identity, {_STORED} AS stored FROM claims) SELECT case_id, claim_id, identity, CASE WHEN stored IS NULL THEN 'legacy_unverified' WHEN stored = identity THEN 'verified' ELSE 'identity_mismatch' END AS status FROM i")
def r10(spark: SparkSession, d: str) -> DataFrame:
    """A hash of what makes a claim itself, and how it compares with the one stored."""
    return _bound(spark, d).select("case_id", "claim_id", "identity", pv.identity_status(F.col("stored"), F.col("identity")).alias("status"))


def _bound(spark: SparkSession, d: str) -> DataFrame:
    rows = claims(spark, d).withColumn("identity", _identity())
    return rows.withColumn("stored", F.when(F.col("case_id") % 5 == 1, "old").when(F.col("case_id") % 5 != 0, F.col("identity")))


@query("r11_rebind", f"WITH {CLAIMS}, i AS (SELECT {_IDENTITY} AS identity, {_STORED} AS stored FROM claims) SELECT CASE WHEN stored IS NULL THEN 'legacy_unverified' WHEN stored = identity THEN 'verified' ELSE 'identity_mismatch' END AS status, count(*) AS n, count(*) FILTER (WHERE stored <> identity) AS with_history, count(*) FILTER (WHERE coalesce(stored, identity) = identity) AS current FROM i GROUP BY 1")
def r11(spark: SparkSession, d: str) -> DataFrame:
    """Identities bound where there was none; what doesn't match stays and is kept as history."""
    out = pv.rebind(_bound(spark, d), "stored", "identity")
    return out.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.size("history") > 0).alias("with_history"), F.count_if(F.col("bound") == F.col("identity")).alias("current"))


@query("r12_gold_case_status", f"WITH {CLAIMS} SELECT case_id, CASE WHEN count(*) FILTER (WHERE outcome <> 'unclear') = 0 THEN 'not_started' WHEN count(*) FILTER (WHERE outcome <> 'unclear') < count(*) THEN 'in_progress' ELSE 'completed' END AS status FROM claims GROUP BY case_id")
def r12(spark: SparkSession, d: str) -> DataFrame:
    """How far the annotation of each case is."""
    out = claims(spark, d).groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") != "unclear").alias("done"))
    return out.select("case_id", F.when(F.col("done") == 0, "not_started").when(F.col("done") < F.col("n"), "in_progress").otherwise("completed").alias("status"))


_BY_AMOUNT = "CASE WHEN asked > 0 AND awarded >= 0 THEN CASE WHEN awarded = 0 THEN 'not_supported' WHEN awarded < asked THEN 'partially_supported' ELSE 'supported' END WHEN outcome = 'not_supported' THEN 'not_supported' ELSE 'unclear' END"


@query(
    "r13_benchmark_scoring",
    f"WITH {CLAIMS}, g AS (SELECT *, {_BY_AMOUNT} AS predicted FROM claims), s AS (SELECT kind, CASE WHEN asked IS NULL THEN 'technical' WHEN provider = 'unknown' THEN 'identity' WHEN outcome = 'unclear' THEN 'unclear_gold' WHEN predicted = 'unclear' THEN 'unresolved' WHEN predicted = outcome THEN 'correct' ELSE 'incorrect' END AS verdict FROM g) SELECT kind, verdict, count(*) AS n FROM s GROUP BY kind, verdict",
)
def r13(spark: SparkSession, d: str) -> DataFrame:
    """What the amounts say of each claim against its gold outcome: claims that gave no amount, and those of unknown parties, come before right and wrong."""
    c = F.col
    predicted = F.coalesce(amount_outcome(c("asked"), c("awarded")), F.when(c("outcome") == "not_supported", "not_supported").otherwise("unclear"))
    verdict = rec.benchmark_verdict(gold=c("outcome"), predicted=predicted, technical=c("asked").isNull(), mismatch=c("provider") == "unknown")
    return claims(spark, d).groupBy("kind", verdict.alias("verdict")).agg(F.count("*").alias("n"))


_CONFIDENCE = "(50 + l_orderkey * 7 % 50) / 100.0"
_REASONS = f"list_filter([CASE WHEN l_linenumber > 6 THEN 'empty_referenced_claim_ids' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'conflicts_with_action' END, CASE WHEN l_quantity >= 50 THEN 'claim_id_not_found' END, CASE WHEN l_suppkey % 11 = 0 THEN 'invalid_provenance' END], {_FILTER})"
_DECIDED = f"c AS (SELECT l_orderkey AS case_id, l_linenumber AS fragment, l_partkey % 4 AS claim, l_returnflag AS treatment, {_CONFIDENCE}::DOUBLE AS confidence, {_REASONS} AS reasons FROM lineitem), v AS (SELECT *, CASE WHEN len(reasons) > 0 OR confidence < 0.7 THEN 'rejected' WHEN confidence < 0.8 THEN 'human_review' ELSE 'accepted' END AS decision FROM c)"


def _line_confidence() -> Column:
    return (50 + F.col("l_orderkey") * 7 % 50) / 100


def _line_reasons() -> Column:
    c = F.col
    return pv.issues(empty_referenced_claim_ids=c("l_linenumber") > 6, conflicts_with_action=(c("l_returnflag") == "R") & (c("l_linestatus") == "O"), claim_id_not_found=c("l_quantity") >= 50, invalid_provenance=c("l_suppkey") % 11 == 0)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = table(spark, d, "lineitem").select(c("l_orderkey").alias("case_id"), c("l_linenumber").alias("fragment"), (c("l_partkey") % 4).alias("claim"), c("l_returnflag").alias("treatment"), _line_confidence().alias("confidence"), _line_reasons().alias("reasons"))
    return rows.withColumn("decision", pv.decision(c("reasons"), c("confidence")))


@query("r16_candidate_validator", f"WITH {_DECIDED} SELECT decision, array_to_string(reasons, ',') AS reasons, count(*) AS n FROM v GROUP BY ALL")
def r16(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by decision, with all reasons against them."""
    return _candidates(spark, d).groupBy("decision", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("r17_enrichment", f"WITH {CLAIMS}, x AS (SELECT case_id, CASE WHEN outcome = 'unclear' AND case_id % 4 = 0 THEN 'supported' ELSE outcome END AS o, outcome FROM claims) SELECT case_id, {_MERGED.format(o='o')} AS outcome, CASE WHEN bool_or(o = 'unclear') AND bool_or(o <> outcome) THEN 'partial' WHEN bool_or(o = 'unclear') THEN 'unresolved' ELSE 'resolved' END AS status FROM x GROUP BY case_id")
def r17(spark: SparkSession, d: str) -> DataFrame:
    """Accepted relations applied to claims, the case's outcome from them, and what is still open."""
    final = F.when((F.col("outcome") == "unclear") & (F.col("case_id") % 4 == 0), "supported").otherwise(F.col("outcome"))
    out = claims(spark, d).groupBy("case_id").agg(F.collect_set(final).alias("os"), F.count_if(final == "unclear").alias("open"), F.count_if(final != F.col("outcome")).alias("changed"))
    status = F.when((F.col("open") > 0) & (F.col("changed") > 0), "partial").when(F.col("open") > 0, "unresolved").otherwise("resolved")
    return out.select("case_id", merged_outcome(F.col("os")).alias("outcome"), status.alias("status"))


@query("r19_review_items", f"WITH {_DECIDED}, i AS (SELECT case_id, fragment, CASE WHEN fragment % 5 = 0 THEN 'unresolved' WHEN fragment % 5 = 1 THEN 'corrected' ELSE 'confirmed' END AS action FROM v WHERE decision = 'human_review') SELECT action, CASE WHEN action = 'unresolved' THEN 'unresolved' ELSE 'reviewed' END AS status, count(*) AS n FROM i GROUP BY ALL")
def r19(spark: SparkSession, d: str) -> DataFrame:
    """Review items of the candidates that need a reviewer; an unresolved one stays so whatever else was entered."""
    action = F.when(F.col("fragment") % 5 == 0, "unresolved").when(F.col("fragment") % 5 == 1, "corrected").otherwise("confirmed")
    items = _candidates(spark, d).where("decision = 'human_review'").select(action.alias("action"))
    return items.groupBy("action", F.when(F.col("action") == "unresolved", "unresolved").otherwise("reviewed").alias("status")).agg(F.count("*").alias("n"))


@query("r20_overlays", f"WITH {PARSED}, o AS (SELECT o_orderkey AS case_id, n.v, n.seq FROM orders, (SELECT unnest([1, 2, 3]) AS seq, unnest(['supported', NULL, 'not_supported']) AS v) n WHERE o_orderkey % 6 = 0 AND n.seq <= 1 + o_orderkey % 4), l AS (SELECT case_id, arg_max_null(v, seq) AS v FROM o GROUP BY case_id) SELECT case_id, coalesce(v, outcome) AS outcome FROM parsed LEFT JOIN l USING (case_id)")
def r20(spark: SparkSession, d: str) -> DataFrame:
    """Accepted overlays laid over records, the newest of each case alone."""
    patches = table(spark, d, "orders").where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("case_id"), F.explode(F.arrays_zip(F.array(F.lit("supported"), F.lit(None), F.lit("not_supported")).alias("v"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("at"))).alias("p"))
    patches = patches.select("case_id", F.col("p.v").alias("outcome"), F.col("p.at").alias("at")).where(F.col("at") <= 1 + F.col("case_id") % 4)
    return rec.overlay(parsed(spark, d).select("case_id", "outcome"), patches, ["case_id"], ["outcome"], "at")


@query("r21_amount_repair", f"WITH {CLAIMS} SELECT case_id, claim_id, CASE WHEN outcome = 'supported' AND asked > awarded AND awarded > 0 AND kind IN ('wages', 'overtime', 'leave') THEN 'partially_supported' ELSE outcome END AS outcome FROM claims")
def r21(spark: SparkSession, d: str) -> DataFrame:
    """A supported claim of money of which less was awarded is partly supported."""
    c = F.col
    less = (c("outcome") == "supported") & (c("asked") > c("awarded")) & (c("awarded") > 0) & c("kind").isin("wages", "overtime", "leave")
    return claims(spark, d).select("case_id", "claim_id", F.when(less, "partially_supported").otherwise(c("outcome")).alias("outcome"))


@query("r22_consistency", f"WITH {PARSED}, {REVIEWS}, i AS (SELECT case_id, unnest(list_filter([CASE WHEN employee = employer AND employee IN ('supported', 'not_supported') THEN 'conflict' END, CASE WHEN meta_date IS NULL AND text_date IS NULL THEN 'missing' END, CASE WHEN new_outcome = 'unclear' AND outcome <> 'unclear' THEN 'false_positive' END], {_FILTER})) AS issue FROM parsed LEFT JOIN reviews USING (case_id)) SELECT * FROM i")
def r22(spark: SparkSession, d: str) -> DataFrame:
    """Contradictions, gaps and false findings of parsed records."""
    c = F.col
    rows = parsed(spark, d).join(reviews(spark, d), "case_id", "left")
    found = pv.issues(conflict=(c("employee") == c("employer")) & c("employee").isin("supported", "not_supported"), missing=c("meta_date").isNull() & c("text_date").isNull(), false_positive=(c("new_outcome") == "unclear") & (c("outcome") != "unclear"))
    return rows.select("case_id", F.explode(found).alias("issue"))


@query("r23_translation_cache", "WITH s AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 2 = 0) SELECT d.doc_id, CASE WHEN s.h IS NULL THEN 'missing' WHEN s.h = sha256(d.text) THEN 'valid' ELSE 'stale' END AS state FROM documents d LEFT JOIN s USING (doc_id)")
def r23(spark: SparkSession, d: str) -> DataFrame:
    """Whether a stored result still belongs to the text it was made from."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("now"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("then"))
    stored = docs.where("doc_id % 2 = 0").select("doc_id", F.col("then").alias("h"))
    return docs.join(stored, "doc_id", "left").select("doc_id", F.when(F.col("h").isNull(), "missing").when(F.col("h") == F.col("now"), "valid").otherwise("stale").alias("state"))


_ROUTED = f"""{_DECIDED.split(", v AS")[0]}, l AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, list_sort(list_distinct([l_partkey % 4, l_suppkey % 4])), l_returnflag, {_CONFIDENCE}::DOUBLE, l_partkey, l_suppkey) AS n,
    list_sort(list_distinct([l_partkey % 4, l_suppkey % 4])) AS ids, l_returnflag AS treatment, {_CONFIDENCE}::DOUBLE AS confidence, {_REASONS} AS reasons FROM lineitem),
    fold AS (SELECT case_id, 0::BIGINT AS n, MAP {{}}::MAP(BIGINT, VARCHAR) AS treated, NULL::VARCHAR AS route, NULL::BOOLEAN AS conflict FROM (SELECT DISTINCT case_id FROM l) UNION ALL
    SELECT case_id, n, CASE WHEN route = 'rejected' THEN treated ELSE map_concat(treated, map_from_entries(list_transform(ids, lambda x: {{'k': x, 'v': treatment}}))) END, route, conflict FROM (
    SELECT *, CASE WHEN conflict OR len(reasons) > 0 OR confidence < 0.7 THEN 'rejected' WHEN confidence < 0.8 THEN 'human_review' ELSE 'accepted' END AS route FROM (
    SELECT l.*, f.treated, len(list_filter(l.ids, lambda x: coalesce(f.treated[x], l.treatment) <> l.treatment)) > 0 AS conflict FROM fold f JOIN l ON l.case_id = f.case_id AND l.n = f.n + 1)))"""


@query("r24_candidate_routing", f"WITH RECURSIVE {_ROUTED} SELECT route, conflict, count(*) AS n FROM fold WHERE n > 0 GROUP BY route, conflict")
def r24(spark: SparkSession, d: str) -> DataFrame:
    """Candidates routed in order: each is held against all earlier ones of its case that were accepted or sent to a reviewer."""
    ids = F.array_sort(F.array_distinct(F.array(F.col("l_partkey") % 4, F.col("l_suppkey") % 4)))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("n"), ids.alias("claim_ids"), F.col("l_returnflag").alias("treatment"), _line_confidence().alias("confidence"), _line_reasons().alias("reasons"), "l_partkey", "l_suppkey")
    out = routing.route(lines, group=["case_id"], order=["n"])
    return out.groupBy("route", F.array_contains("reasons", routing.CONFLICT).alias("conflict")).agg(F.count("*").alias("n"))


@query("r27_snapshot_export", f"""WITH {RECORDS}, s AS (SELECT has_review, included, coalesce(role, '') AS role, count(*) AS n FROM records GROUP BY ALL) SELECT role, '{{"role":"' || role || '","cells":[' || string_agg('{{"reviewed":' || has_review || ',"included":' || included || ',"n":' || n || '}}', ',' ORDER BY has_review, included) || ']}}' AS snapshot FROM s GROUP BY role""")
def r27(spark: SparkSession, d: str) -> DataFrame:
    """A nested snapshot of counts for each role, as JSON."""
    counts = records(spark, d).groupBy("role", F.col("has_review").alias("reviewed"), "included").agg(F.count("*").alias("n"))
    cells = counts.groupBy("role").agg(F.array_sort(F.collect_list(F.struct("reviewed", "included", "n"))).alias("cells"))  # four cells at most
    return cells.select("role", F.to_json(F.struct("role", "cells")).alias("snapshot"))


@query("m10_provenance_chain", f"""WITH {_RUNS}, s AS (SELECT *, sha256('["v1","' || first || '","' || last || '"]') AS snapshot FROM runs), p AS (SELECT *, sha256('["' || snapshot || '","' || n || '"]') AS sampling FROM s) SELECT o_custkey, snapshot, sha256('["' || snapshot || '","' || sampling || '","' || total || '"]') AS run FROM p""")
def m10(spark: SparkSession, d: str) -> DataFrame:
    """A chain of hashes: snapshot, sample, run."""
    rows = _runs(spark, d).withColumn("snapshot", pv.chain(F.lit("v1"), F.col("first"), F.col("last")))
    rows = rows.withColumn("sampling", pv.chain(F.col("snapshot"), F.col("n")))
    return rows.select("o_custkey", "snapshot", pv.chain(F.col("snapshot"), F.col("sampling"), F.col("total")).alias("run"))


CONTRACT = {"type": "object", "required": ["k", "v"], "additionalProperties": False, "properties": {"k": {"type": "integer", "enum": list(range(50))}, "v": {"type": "string"}}}


@query("n09_schema_walker", "SELECT event_id, 'v' AS path, 'missing_required_field' AS code FROM events UNION ALL SELECT event_id, 'k', 'invalid_enum' FROM events WHERE (props->>'k')::INTEGER >= 50")
def n09(spark: SparkSession, d: str) -> DataFrame:
    """Every place where a JSON value breaks its contract."""
    return table(spark, d, "events").select("event_id", F.explode(contracts.broken(F.col("props"), CONTRACT)).alias("x")).select("event_id", "x.*")


@query("t35_compatible_text")
def t35(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(unicode.compatible(F.col("text")), 256).alias("text_sha256"))


@query("t37_lossless_pieces", "SELECT doc_id, sha256(text) AS joined_sha256, true AS within FROM documents WHERE text <> ''")
def t37(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of texts; joined they are the text again."""
    rows = table(spark, d, "documents").where("text <> ''").select("doc_id", unicode.pieces(F.col("text"), 3000).alias("p"))
    return rows.select("doc_id", F.sha2(F.array_join("p", ""), 256).alias("joined_sha256"), F.forall("p", lambda x: F.length(x) <= 3000).alias("within"))


@query("a27_rule_against_review", f"WITH {PARSED}, {REVIEWS}, b AS (SELECT outcome, coalesce(new_outcome, outcome) AS reviewed FROM parsed LEFT JOIN reviews USING (case_id)) SELECT 'rule' AS kind, count(*) FILTER (WHERE outcome = 'supported') AS won, round(count(*) FILTER (WHERE outcome = 'supported')::DOUBLE / count(*) FILTER (WHERE outcome <> 'unclear') * 100, 1) AS rate FROM b UNION ALL SELECT 'reviewed', count(*) FILTER (WHERE reviewed = 'supported'), round(count(*) FILTER (WHERE reviewed = 'supported')::DOUBLE / count(*) FILTER (WHERE reviewed <> 'unclear') * 100, 1) FROM b")
def a27(spark: SparkSession, d: str) -> DataFrame:
    """A rate from the rules alone, and after review."""
    both = parsed(spark, d).join(reviews(spark, d), "case_id", "left").select("outcome", F.coalesce("new_outcome", "outcome").alias("reviewed"))
    long = both.select(F.explode(F.array(F.struct(F.lit("rule").alias("kind"), F.col("outcome").alias("o")), F.struct(F.lit("reviewed").alias("kind"), F.col("reviewed").alias("o")))).alias("x")).groupBy("x.kind")
    out = long.agg(F.count_if(F.col("x.o") == "supported").alias("won"), F.count_if(F.col("x.o") != "unclear").alias("known"))
    return out.select("kind", "won", percent(F.col("won"), F.col("known")).alias("rate"))
