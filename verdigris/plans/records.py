"""Queries of analysis records, claims, reviews and statistics built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions.rates import merged_outcome, percent
from verdigris.operators import records as rec
from verdigris.plans.registry import query
from verdigris.sources.records import CLAIMS, PARSED, REVIEWS, claims, parsed, reviews
from verdigris.sources.tables import CASES, ITEMS, case_items, cases, table

_VALID = lambda c: f"CASE WHEN year(TRY_CAST({c} AS DATE)) BETWEEN 1900 AND 2100 THEN TRY_CAST({c} AS DATE) END"
_CLASH = lambda new, other: f"({new} IN ('supported', 'not_supported') AND {new} = {other})"
_ONE = lambda new, old, other: f"CASE WHEN {new} IS NOT NULL AND {old} = 'unclear' AND NOT {_CLASH(new, other)} THEN {new} ELSE {old} END"
_BOTH = "new_employee IS NOT NULL AND new_employer IS NOT NULL"
RECORDS = f"""{PARSED}, {REVIEWS}, records AS (SELECT case_id, coalesce(new_outcome, outcome) AS outcome, CASE WHEN {_BOTH} THEN new_employee ELSE {_ONE("new_employee", "employee", "employer")} END AS employee, CASE WHEN {_BOTH} THEN new_employer ELSE {_ONE("new_employer", "employer", "employee")} END AS employer,
 CASE WHEN len(new_kinds) > 0 THEN new_kinds ELSE kinds END AS kinds, CASE WHEN source = 'registry' THEN coalesce({_VALID("meta_date")}, {_VALID("text_date")}) ELSE coalesce({_VALID("text_date")}, {_VALID("meta_date")}) END AS date,
 CASE WHEN status = 'approved' THEN 1.0 WHEN status = 'modified' THEN 0.95 ELSE least(greatest(round(score * 0.009, 2), 0.4), 0.92) END::DOUBLE AS confidence, coalesce(status = 'approved', false) OR score >= 80 AS included, CASE WHEN NOT (coalesce(status = 'approved', false) OR score >= 80) THEN 'score_below_80' END AS filter_reason, status IS NOT NULL AS has_review, score, role
 FROM parsed LEFT JOIN reviews USING (case_id))"""


def records(spark: SparkSession, d: str) -> DataFrame:
    return rec.analysis_records(parsed(spark, d), reviews(spark, d))


@query("p01_analysis_record", f"WITH {RECORDS} SELECT case_id, outcome, array_to_string(kinds, ';') AS kinds, has_review, included FROM records")
def p01(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("case_id", "outcome", F.array_join("kinds", ";").alias("kinds"), "has_review", "included")


@query("p02_reviewed_sides", f"WITH {RECORDS} SELECT case_id, employee, employer FROM records")
def p02(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("case_id", "employee", "employer")


@query("p03_analysis_set", f"WITH {RECORDS} SELECT included, filter_reason, count(*) AS n FROM records GROUP BY ALL")
def p03(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("included", "filter_reason").agg(F.count("*").alias("n"))


@query("p04_confidence", f"WITH {RECORDS} SELECT confidence, count(*) AS n FROM records GROUP BY confidence")
def p04(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("confidence").agg(F.count("*").alias("n"))


@query("p05_authoritative_date", f"WITH {RECORDS} SELECT case_id, date::VARCHAR AS date FROM records")
def p05(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("case_id", F.col("date").cast("string").alias("date"))


@query(
    "p06_admission_projection",
    f"""WITH {CLAIMS}, h AS (SELECT * FROM claims WHERE case_id % 6 = 0), x AS (SELECT claims.*, CASE WHEN case_id % 6 = 0 AND outcome = 'unclear' THEN 'not_supported' ELSE outcome END AS final FROM claims)
    SELECT case_id, CASE WHEN bool_or(final = 'partially_supported') OR (bool_or(final = 'supported') AND bool_or(final = 'not_supported')) THEN 'partially_supported' WHEN bool_or(final = 'supported') THEN 'supported' WHEN bool_or(final = 'not_supported') THEN 'not_supported' ELSE 'unclear' END AS outcome, count(*) FILTER (WHERE final <> outcome) AS changed FROM x GROUP BY case_id""",
)
def p06(spark: SparkSession, d: str) -> DataFrame:
    """Accepted results laid over claims by their number within the case, and the case's outcome from them."""
    rows = claims(spark, d)
    accepted = rows.where((F.col("case_id") % 6 == 0) & (F.col("outcome") == "unclear")).groupBy("case_id").agg(F.map_from_entries(F.collect_set(F.struct("claim_id", F.lit("not_supported")))).alias("accepted"))
    one = rows.groupBy("case_id").agg(F.collect_list(F.struct("claim_id", "outcome")).alias("claims")).join(accepted, "case_id", "left")  # a case has a handful of claims
    final = F.transform("claims", lambda c: F.struct(F.coalesce(F.when(c["outcome"] == "unclear", F.try_element_at("accepted", c["claim_id"])), c["outcome"]).alias("final"), c["outcome"].alias("before")))
    out = one.select("case_id", final.alias("x"))
    return out.select("case_id", merged_outcome(F.transform("x", lambda c: c["final"])).alias("outcome"), F.size(F.filter("x", lambda c: c["final"] != c["before"])).cast("long").alias("changed"))


@query("p07_candidates", f"WITH {PARSED} SELECT case_id, year({_VALID('meta_date')})::INTEGER AS year, coalesce(nullif(trim(kinds[1]), ''), 'unknown') AS level FROM parsed")
def p07(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a population; the year comes from a valid date of the metadata alone."""
    rows = parsed(spark, d)
    return rows.select("case_id", F.year(rec.calendar_date(F.col("meta_date"))).alias("year"), F.coalesce(F.nullif(F.trim(F.get("kinds", F.lit(0))), F.lit("")), F.lit("unknown")).alias("level"))


@query(
    "p08_case_profile",
    f"""WITH {CASES}, {ITEMS}, t AS (SELECT case_id, list_sort(list_distinct(list(kind))) AS kinds, list_sort(list_distinct(list(brand))) AS brands FROM items GROUP BY case_id)
    SELECT case_id, outcome, array_to_string(list_sort(list_distinct(list_append(coalesce(kinds, []), segment))), ';') AS disputes, array_to_string(coalesce(brands, []), ';') AS evidence, coalesce(len(kinds), 0) > 2 AS wide FROM cases LEFT JOIN t USING (case_id)""",
)
def p08(spark: SparkSession, d: str) -> DataFrame:
    """A case with its kinds and tags, its evidence, and a flag."""
    none = F.array().cast("array<string>")
    tags = case_items(spark, d).groupBy("case_id").agg(F.collect_set("kind").alias("kinds"), F.collect_set("brand").alias("brands"))
    rows = cases(spark, d).join(tags, "case_id", "left")
    disputes = F.array_sort(F.array_union(F.coalesce("kinds", none), F.array("segment")))
    return rows.select("case_id", "outcome", F.array_join(disputes, ";").alias("disputes"), F.array_join(F.array_sort(F.coalesce("brands", none)), ";").alias("evidence"), (F.coalesce(F.size("kinds"), F.lit(0)) > 2).alias("wide"))


_LEGACY = "CASE WHEN role = 'unknown' THEN '调解/其他' WHEN outcome = 'partially_supported' THEN '部分支持' WHEN outcome = 'unclear' THEN '调解/其他' WHEN (outcome = 'supported') = (role = 'employee') THEN '用人单位败诉' ELSE '用人单位胜诉' END"


@query("p11_legacy_outcome", f"WITH {PARSED} SELECT {_LEGACY} AS legacy, count(*) AS n FROM parsed GROUP BY 1")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).groupBy(rec.legacy_outcome(F.col("outcome"), F.col("role")).alias("legacy")).agg(F.count("*").alias("n"))


@query("p12_short_names", "SELECT c_custkey, coalesce(nullif(replace(replace(c_name, 'Customer#', ''), '0', ''), ''), 'central') AS short FROM customer")
def p12(spark: SparkSession, d: str) -> DataFrame:
    """A name without its fixed parts; what is left empty has a name of its own."""
    short = F.replace(F.replace("c_name", F.lit("Customer#"), F.lit("")), F.lit("0"), F.lit(""))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(short, F.lit("")), F.lit("central")).alias("short"))


@query(
    "p14_claim_owner",
    f"WITH {CLAIMS}, o AS (SELECT case_id, kind, list_distinct(list(role) FILTER (WHERE outcome IN ('supported', 'partially_supported'))) AS roles, count(*) AS n FROM claims GROUP BY case_id, kind) SELECT case_id, kind, CASE WHEN len(roles) = 1 THEN roles[1] WHEN kind = 'termination' THEN 'employee' ELSE 'unknown' END AS owner FROM o",
)
def p14(spark: SparkSession, d: str) -> DataFrame:
    """Whose claim it is: the one role among orders that pay or support, else by the kind of claim."""
    roles = F.collect_set(F.when(F.col("outcome").isin("supported", "partially_supported"), F.col("role")))
    out = claims(spark, d).groupBy("case_id", "kind").agg(roles.alias("roles"))
    return out.select("case_id", "kind", F.when(F.size("roles") == 1, F.get("roles", F.lit(0))).when(F.col("kind") == "termination", "employee").otherwise("unknown").alias("owner"))


@query(
    "p16_summaries",
    f"WITH {CASES}, s AS (SELECT city, count(*) FILTER (WHERE outcome = 'supported') AS won, count(*) FILTER (WHERE outcome <> 'unclear') AS known FROM cases WHERE amount > 200000 GROUP BY city) SELECT city, concat_ws(' · ', city, CASE WHEN known > 0 THEN 'known ' || known END) AS summary, CASE WHEN known > 0 THEN printf('%.1f%%', round(won::DOUBLE / known * 100, 1)) ELSE 'insufficient' END AS rate FROM s",
)
def p16(spark: SparkSession, d: str) -> DataFrame:
    """Texts of figures: unknown parts are left out, a rate over nothing says so."""
    s = cases(spark, d).where("amount > 200000").groupBy("city").agg(F.count_if(F.col("outcome") == "supported").alias("won"), F.count_if(F.col("outcome") != "unclear").alias("known"))
    rate = F.when(F.col("known") > 0, F.format_string("%.1f%%", percent(F.col("won"), F.col("known")))).otherwise("insufficient")
    return s.select("city", F.concat_ws(" · ", "city", F.when(F.col("known") > 0, F.concat(F.lit("known "), F.col("known").cast("string")))).alias("summary"), rate.alias("rate"))


@query(
    "p17_diagnostic_evidence",
    f"WITH {CLAIMS} SELECT case_id, claim_id, CASE WHEN outcome <> 'unclear' THEN 'disposition' WHEN asked IS NOT NULL THEN 'claim' ELSE 'none' END AS kind, coalesce(CASE WHEN outcome <> 'unclear' THEN outcome END, CASE WHEN asked IS NOT NULL THEN 'asked ' || claim_id END, 'none') AS evidence FROM claims",
)
def p17(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a diagnosis: a disposition if there is one, else the claim, which never counts as a disposition."""
    known, asked = F.col("outcome") != "unclear", F.col("asked").isNotNull()
    text = F.coalesce(F.when(known, F.col("outcome")), F.when(asked, F.concat(F.lit("asked "), F.col("claim_id").cast("string"))), F.lit("none"))
    return claims(spark, d).select("case_id", "claim_id", F.when(known, "disposition").when(asked, "claim").otherwise("none").alias("kind"), text.alias("evidence"))


DELTA = [f"NATION_{k}" for k in (1, 3, 5, 7, 9)]


@query("f06_geographic_scope", f"WITH {CASES} SELECT s.scope, count(*) AS n FROM cases JOIN nation ON city = n_name, (SELECT unnest(['all', 'province', 'delta', 'custom']) AS scope) s WHERE scope = 'all' OR (scope = 'province' AND n_regionkey = 1) OR (scope = 'delta' AND city IN ({', '.join(repr(x) for x in DELTA)})) OR (scope = 'custom' AND city IN ('NATION_2', 'NATION_4')) GROUP BY s.scope")
def f06(spark: SparkSession, d: str) -> DataFrame:
    """Cases within each kind of scope: all, a province, a fixed list of cities, a list of one's own."""
    rows = cases(spark, d).join(table(spark, d, "nation"), F.col("city") == F.col("n_name"))
    scopes = {"all": F.lit(True), "province": F.col("n_regionkey") == 1, "delta": F.col("city").isin(DELTA), "custom": F.col("city").isin("NATION_2", "NATION_4")}
    within = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in scopes.items())))
    return rows.select(F.explode(within).alias("scope")).groupBy("scope").agg(F.count("*").alias("n"))


@query("f11_employer_evidence", f"WITH {CLAIMS} SELECT case_id, count(*) AS n FROM claims WHERE provider = 'employer' GROUP BY case_id")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return claims(spark, d).where(F.lower(F.trim("provider")) == "employer").groupBy("case_id").agg(F.count("*").alias("n"))


@query("f12_executable_references", "SELECT conv_id, turn FROM conversations WHERE trim(coalesce(text, '')) <> '' AND role <> 'system' AND turn >= 1")
def f12(spark: SparkSession, d: str) -> DataFrame:
    """References that can be worked on: they have text, are unresolved and point at something."""
    rows = table(spark, d, "conversations").withColumn("refs", F.when(F.col("turn") >= 1, F.array(F.col("turn") - 1)).otherwise(F.array().cast("array<long>")))
    return rows.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("role") != "system") & (F.size("refs") > 0)).select("conv_id", "turn")


_STAGE = "CASE WHEN score < 10 THEN 'failed' WHEN score < 20 THEN 'parsing' WHEN has_review AND included THEN 'reviewed' WHEN included THEN 'admitted' WHEN outcome = 'unclear' THEN 'needs_review' ELSE 'blocked' END"


def stage():
    c = F.col
    return F.when(c("score") < 10, "failed").when(c("score") < 20, "parsing").when(c("has_review") & c("included"), "reviewed").when(c("included"), "admitted").when(c("outcome") == "unclear", "needs_review").otherwise("blocked")


@query("f13_processing_stage", f"WITH {RECORDS} SELECT case_id, {_STAGE} AS stage FROM records")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("case_id", stage().alias("stage"))


@query("f14_review_queue", f"WITH {CLAIMS} SELECT case_id, claim_id, CASE WHEN asked IS NULL THEN 'amount' ELSE 'outcome' END AS category FROM claims WHERE outcome = 'unclear' AND contains(lower(kind), 'e') AND role = 'employee'")
def f14(spark: SparkSession, d: str) -> DataFrame:
    """Open review items by status, category and a search word."""
    rows = claims(spark, d).where((F.col("outcome") == "unclear") & F.contains(F.lower("kind"), F.lit("e")) & (F.col("role") == "employee"))
    return rows.select("case_id", "claim_id", F.when(F.col("asked").isNull(), "amount").otherwise("outcome").alias("category"))


@query("f15_run_list", "SELECT o_orderkey AS run_id FROM orders WHERE o_custkey < 100 AND o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def f15(spark: SparkSession, d: str) -> DataFrame:
    from verdigris.operators.filters import facets

    return facets(table(spark, d, "orders").where("o_custkey < 100"), equal={"o_orderstatus": "F", "o_orderpriority": "5-LOW", "o_clerk": None}).select(F.col("o_orderkey").alias("run_id"))


@query("j15_party_resolution", f"WITH {CLAIMS}, p AS (SELECT case_id, role, min(claim_id) FILTER (WHERE provider = 'court') AS exact, min(claim_id) AS any_one FROM claims GROUP BY case_id, role) SELECT c.case_id, c.claim_id, coalesce(exact, any_one) AS party FROM claims c JOIN p USING (case_id, role)")
def j15(spark: SparkSession, d: str) -> DataFrame:
    """The party of a claim within the case: by role and position, else by role alone; parties are a short array of the case."""
    rows = claims(spark, d)
    sides = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "role", "provider"))).alias("parties"))
    first = lambda test: F.get(F.filter("parties", test), F.lit(0))["claim_id"]
    role = F.col("role")
    return rows.select("case_id", "claim_id", "role").join(sides, "case_id").select("case_id", "claim_id", F.coalesce(first(lambda p: (p["role"] == role) & (p["provider"] == "court")), first(lambda p: p["role"] == role)).alias("party"))


@query("j18_not_in_gold", f"WITH {CASES} SELECT case_id FROM cases ANTI JOIN labels ON case_id = doc_id")
def j18(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).join(table(spark, d, "labels"), F.col("case_id") == F.col("doc_id"), "left_anti").select("case_id")


@query(
    "a08_defense_ranking",
    f"""WITH {CLAIMS}, {ITEMS}, r AS (SELECT case_id, outcome, kind IN ('termination', 'wages') AS related FROM claims WHERE role = 'employee'), a AS (SELECT case_id, bool_or(related) AS near FROM r GROUP BY case_id),
    u AS (SELECT case_id, CASE WHEN bool_or(outcome = 'partially_supported') OR (bool_or(outcome = 'supported') AND bool_or(outcome = 'not_supported')) THEN 'partial' WHEN bool_or(outcome = 'not_supported') THEN 'won' WHEN bool_or(outcome = 'supported') THEN 'lost' ELSE 'unclear' END AS deduced FROM r JOIN a USING (case_id) WHERE related OR NOT near GROUP BY case_id),
    k AS (SELECT DISTINCT case_id, kind AS defense FROM items), s AS (SELECT defense, count(*) AS cases, count(*) FILTER (WHERE deduced = 'won') AS won, count(*) FILTER (WHERE deduced IN ('won', 'lost', 'partial')) AS known FROM k LEFT JOIN u USING (case_id) GROUP BY defense)
    SELECT *, CASE WHEN known > 0 THEN round(won::DOUBLE / known * 100, 1) END AS rate FROM s""",
)
def a08(spark: SparkSession, d: str) -> DataFrame:
    """Defences by the outcome that the employee's related claims let deduce; all their claims count where none is related."""
    rows = claims(spark, d).where("role = 'employee'")
    related = F.collect_set(F.when(F.col("kind").isin("termination", "wages"), F.col("outcome")))
    one = rows.groupBy("case_id").agg(related.alias("near"), F.collect_set("outcome").alias("every"))
    merged = merged_outcome(F.when(F.size("near") > 0, F.col("near")).otherwise(F.col("every")))
    deduced = F.when(merged == "not_supported", "won").when(merged == "supported", "lost").when(merged == "partially_supported", "partial").otherwise("unclear")
    defenses = case_items(spark, d).select("case_id", F.col("kind").alias("defense")).distinct()
    out = defenses.join(one.select("case_id", deduced.alias("deduced")), "case_id", "left").groupBy("defense")
    out = out.agg(F.count("*").alias("cases"), F.count_if(F.col("deduced") == "won").alias("won"), F.count_if(F.col("deduced").isin("won", "lost", "partial")).alias("known"))
    return out.withColumn("rate", percent(F.col("won"), F.col("known")))


@query("a13_by_committee", f"WITH {CASES} SELECT coalesce(nullif(replace(city, 'NATION_', ''), ''), 'central') AS committee, count(*) AS n, count(*) FILTER (WHERE outcome = 'supported') AS won, count(*) FILTER (WHERE outcome = 'not_supported') AS lost, count(*) FILTER (WHERE outcome NOT IN ('supported', 'not_supported')) AS partial FROM cases GROUP BY 1")
def a13(spark: SparkSession, d: str) -> DataFrame:
    """By short committee name; all other outcomes are lumped together."""
    name = F.coalesce(F.nullif(F.replace("city", F.lit("NATION_"), F.lit("")), F.lit("")), F.lit("central"))
    won, lost = F.col("outcome") == "supported", F.col("outcome") == "not_supported"
    return cases(spark, d).groupBy(name.alias("committee")).agg(F.count("*").alias("n"), F.count_if(won).alias("won"), F.count_if(lost).alias("lost"), F.count_if(~won & ~lost).alias("partial"))


_TOP = "list_sort(list({'n': -n, 'x': x}))"


@query(
    "a17_defense_outcome",
    f"""WITH {CASES}, {ITEMS}, k AS (SELECT DISTINCT case_id, kind FROM items), s AS (SELECT kind, count(*) AS total, count(*) FILTER (WHERE outcome = 'not_supported') AS win, count(*) FILTER (WHERE outcome = 'partially_supported') AS partial FROM k JOIN cases USING (case_id) GROUP BY kind),
    e AS (SELECT kind, brand, count(DISTINCT case_id) AS n FROM items GROUP BY kind, brand QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, brand) <= 4), t AS (SELECT kind, string_agg(brand, ';' ORDER BY n DESC, brand) AS evidence FROM e GROUP BY kind)
    SELECT s.*, round(win::DOUBLE / total * 100, 2) AS win_rate, evidence FROM s JOIN t USING (kind)""",
)
def a17(spark: SparkSession, d: str) -> DataFrame:
    """Legacy effect of each defence over all its cases, with its four most frequent pieces of evidence."""
    items = case_items(spark, d)
    stats = items.select("case_id", "kind").distinct().join(cases(spark, d).select("case_id", "outcome"), "case_id").groupBy("kind")
    stats = stats.agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "not_supported").alias("win"), F.count_if(F.col("outcome") == "partially_supported").alias("partial"))
    counts = items.groupBy("kind", "brand").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "brand"))).where("k <= 4")
    top = ranked.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "brand"))), lambda x: x["brand"]), ";").alias("evidence"))
    return stats.withColumn("win_rate", percent(F.col("win"), F.col("total"), 2)).join(top, "kind")


@query("a18_defense_evidence_combos", f"WITH {CASES}, {ITEMS} SELECT kind || ' + ' || brand AS combo, count(*) AS n, count(*) FILTER (WHERE outcome = 'supported') AS supported FROM items JOIN cases USING (case_id) GROUP BY 1 ORDER BY n DESC, combo LIMIT 20")
def a18(spark: SparkSession, d: str) -> DataFrame:
    rows = case_items(spark, d).join(cases(spark, d).select("case_id", "outcome"), "case_id")
    out = rows.groupBy(F.concat_ws(" + ", "kind", "brand").alias("combo")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "supported").alias("supported"))
    return out.orderBy(F.desc("n"), "combo").limit(20)


@query(
    "a19_loss_reasons",
    f"""WITH {CASES}, {ITEMS}, l AS (SELECT case_id FROM cases WHERE outcome IN ('supported', 'partially_supported')), r AS (SELECT DISTINCT case_id, brand AS reason FROM items JOIN l USING (case_id)), q AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY case_id) AS k FROM r)
    SELECT reason, count(*) AS n, round(count(*)::DOUBLE / greatest((SELECT count(*) FROM l), 1) * 100, 1) AS share, string_agg(case_id::VARCHAR, ';' ORDER BY case_id) FILTER (WHERE k <= 5) AS samples FROM q GROUP BY reason""",
)
def a19(spark: SparkSession, d: str) -> DataFrame:
    """Reasons among lost cases with five sample ids each; a task keeps five of a reason before the shuffle."""
    lost = cases(spark, d).where(F.col("outcome").isin("supported", "partially_supported")).select("case_id")
    total = max(lost.count(), 1)
    rows = case_items(spark, d).join(lost, "case_id").select("case_id", F.col("brand").alias("reason")).distinct()
    counts = rows.groupBy("reason").agg(F.count("*").alias("n"))
    few = rows.withColumn("k", F.row_number().over(Window.partitionBy("reason").orderBy("case_id"))).where("k <= 5").groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list("case_id")), lambda x: x.cast("string")), ";").alias("samples"))
    return counts.withColumn("share", percent(F.col("n"), F.lit(total), none=0.0)).join(few, "reason")


@query(
    "a20_local_report",
    f"""WITH {CASES}, {ITEMS}, k AS (SELECT DISTINCT case_id, kind FROM items), b AS (SELECT DISTINCT case_id, brand FROM items)
    SELECT 'outcome' AS part, outcome AS value, count(*) AS n FROM cases GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'brand', brand, count(*) FROM b GROUP BY 2 UNION ALL SELECT 'year', year::VARCHAR, count(*) FROM cases GROUP BY 2 UNION ALL SELECT 'segment', segment, count(*) FROM cases GROUP BY 2""",
)
def a20(spark: SparkSession, d: str) -> DataFrame:
    """All distributions of a report in one pass: each case's values are exploded once and counted together."""
    tags = case_items(spark, d).groupBy("case_id").agg(F.collect_set("kind").alias("ks"), F.collect_set("brand").alias("bs"))
    rows = cases(spark, d).join(tags, "case_id", "left")
    one = lambda part, value: F.struct(F.lit(part).alias("part"), value.cast("string").alias("value"))
    none = F.array().cast("array<string>")
    parts = F.concat(F.array(one("outcome", F.col("outcome")), one("year", F.col("year")), one("segment", F.col("segment"))), F.transform(F.coalesce("ks", none), lambda x: one("kind", x)), F.transform(F.coalesce("bs", none), lambda x: one("brand", x)))
    return rows.select(F.explode(parts).alias("x")).groupBy("x.part", "x.value").agg(F.count("*").alias("n"))


@query("a27_overlay_impact", f"WITH {PARSED}, {REVIEWS} SELECT status, count(*) AS n, count(new_outcome) AS touched, count(*) FILTER (WHERE new_outcome IS NOT NULL AND new_outcome <> outcome) AS changed FROM parsed JOIN reviews USING (case_id) GROUP BY status")
def a27(spark: SparkSession, d: str) -> DataFrame:
    """How many reviews there are by status, and how many of them change an outcome."""
    both = parsed(spark, d).join(reviews(spark, d), "case_id")
    return both.groupBy("status").agg(F.count("*").alias("n"), F.count("new_outcome").alias("touched"), F.count_if(F.col("new_outcome").isNotNull() & (F.col("new_outcome") != F.col("outcome"))).alias("changed"))


@query("a31_eligibility", f"WITH {RECORDS} SELECT count(*) FILTER (WHERE has_review AND included) AS verified, count(*) FILTER (WHERE has_review AND NOT included) AS mismatch, count(*) FILTER (WHERE NOT has_review AND included) AS legacy, count(*) FILTER (WHERE NOT has_review AND NOT included) AS missing FROM records")
def a31(spark: SparkSession, d: str) -> DataFrame:
    r, i = F.col("has_review"), F.col("included")
    return records(spark, d).agg(F.count_if(r & i).alias("verified"), F.count_if(r & ~i).alias("mismatch"), F.count_if(~r & i).alias("legacy"), F.count_if(~r & ~i).alias("missing"))


@query("a32_stage_counts", f"WITH {RECORDS}, s AS (SELECT {_STAGE} AS stage FROM records) SELECT stage, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM s) * 100, 1) AS share FROM s GROUP BY stage")
def a32(spark: SparkSession, d: str) -> DataFrame:
    from verdigris.operators.stats import distribution

    return distribution(records(spark, d), stage(), "stage")


@query("a33_run_stats", f"WITH {RECORDS}, t AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) SELECT count(*) AS scanned, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS empty, count(*) FILTER (WHERE k > 1) AS duplicates, count(*) FILTER (WHERE r.case_id IS NOT NULL) AS parsed, count(*) FILTER (WHERE score < 10) AS failed, count(*) FILTER (WHERE included) AS included FROM t LEFT JOIN records r ON doc_id = r.case_id")
def a33(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a pipeline run: what was scanned, empty, a copy, parsed, failed, included."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), (F.coalesce(F.trim("text"), F.lit("")) == "").alias("is_empty"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    rows = docs.join(first, docs["h"].eqNullSafe(first["h"])).join(records(spark, d), F.col("doc_id") == F.col("case_id"), "left")
    return rows.agg(F.count("*").alias("scanned"), F.count_if("is_empty").alias("empty"), F.count_if(F.col("first") != F.col("doc_id")).alias("duplicates"), F.count("case_id").alias("parsed"), F.count_if(F.col("score") < 10).alias("failed"), F.count_if("included").alias("included"))


@query("a35_parser_batch", f"WITH {PARSED} SELECT source, count(*) AS n, round(avg(score), 2) AS mean, count(*) FILTER (WHERE score >= 90) AS a, count(*) FILTER (WHERE score >= 75 AND score < 90) AS b, count(*) FILTER (WHERE score >= 60 AND score < 75) AS c, count(*) FILTER (WHERE score < 60) AS d, count(*) FILTER (WHERE employee = employer AND employee IN ('supported', 'not_supported')) AS conflicts FROM parsed GROUP BY source")
def a35(spark: SparkSession, d: str) -> DataFrame:
    s, c = F.col("score"), F.col("employee")
    return parsed(spark, d).groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 2).alias("mean"), F.count_if(s >= 90).alias("a"), F.count_if((s >= 75) & (s < 90)).alias("b"), F.count_if((s >= 60) & (s < 75)).alias("c"), F.count_if(s < 60).alias("d"),
        F.count_if((c == F.col("employer")) & c.isin("supported", "not_supported")).alias("conflicts"),
    )


@query("a38_failure_codes", "SELECT event_type AS code, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY event_type ORDER BY n DESC, code LIMIT 4")
def a38(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type <> 'view'").groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(4)


@query("a39_sampling_bias", f"WITH {CASES} SELECT case_id // 500 AS page_window, level, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY case_id // 500) * 100, 1) AS share FROM cases GROUP BY 1, 2")
def a39(spark: SparkSession, d: str) -> DataFrame:
    """The distribution of a category within each window of pages."""
    counts = cases(spark, d).groupBy(F.floor(F.col("case_id") / 500).alias("page_window"), "level").agg(F.count("*").alias("n"))
    totals = counts.groupBy("page_window").agg(F.sum("n").alias("t"))
    return counts.join(totals, "page_window").select("page_window", "level", "n", percent(F.col("n"), F.col("t")).alias("share"))


@query("o01_sorted", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def o01(spark: SparkSession, d: str) -> DataFrame:
    """By one of several keys, ascending or descending, ties by id."""
    return _by(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), "price", descending=True).select("o_orderkey", "o_totalprice").limit(50)


def _by(df: DataFrame, key: str, *, descending: bool) -> DataFrame:
    columns = {"price": "o_totalprice", "date": "o_orderdate", "id": "o_orderkey"}
    c = F.col(columns[key])
    return df.orderBy(c.desc() if descending else c.asc(), "o_orderkey")


@query("o04_two_key_top", f"WITH {ITEMS} SELECT brand, count(*) AS n, count(DISTINCT kind) AS kinds FROM items GROUP BY brand ORDER BY n DESC, kinds DESC, brand LIMIT 10")
def o04(spark: SparkSession, d: str) -> DataFrame:
    return case_items(spark, d).groupBy("brand").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("kinds")).orderBy(F.desc("n"), F.desc("kinds"), "brand").limit(10)


@query("o05_multi_key", f"WITH {CASES} SELECT city, level, count(*) AS n FROM cases GROUP BY city, level ORDER BY n DESC, level, city LIMIT 30")
def o05(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).groupBy("city", "level").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level", "city").limit(30)


@query("o06_worst_first", f"WITH {RECORDS} SELECT case_id, score FROM records ORDER BY score, case_id LIMIT 20")
def o06(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).orderBy("score", "case_id").select("case_id", "score").limit(20)


@query("o07_collated", "SELECT DISTINCT p_name FROM part WHERE p_name >= 'a'")
def o07(spark: SparkSession, d: str) -> DataFrame:
    """Names in the order of a language; the order is that of the frame, which SQL here can't check."""
    return table(spark, d, "part").where("p_name >= 'a'").select("p_name").distinct().orderBy(F.collate("p_name", "zh"))


@query("e07_list_equality", "SELECT o_custkey, list_sort(list(o_orderpriority)) = list_sort(list_distinct(list(o_orderpriority))) AS all_different FROM orders GROUP BY o_custkey")
def e07(spark: SparkSession, d: str) -> DataFrame:
    """Two lists are equal as multisets if their sorted forms are."""
    one = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    lists = one.groupBy("o_custkey").agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("o_orderpriority", F.col("n").cast("int"))))).alias("x"), F.array_sort(F.collect_list("o_orderpriority")).alias("y"))
    return lists.select("o_custkey", (F.col("x") == F.col("y")).alias("all_different"))


@query("n02_struct_arrays", f"WITH {CLAIMS} SELECT case_id, bool_or(outcome = 'unclear') AS some_unclear, bool_and(role = 'employee') AS all_employee, count(*) FILTER (WHERE asked > 20000) AS large FROM claims GROUP BY case_id")
def n02(spark: SparkSession, d: str) -> DataFrame:
    """exists, forall and filter over an array of structs."""
    one = claims(spark, d).groupBy("case_id").agg(F.collect_list(F.struct("outcome", "role", "asked")).alias("c"))
    large = F.size(F.filter("c", lambda x: F.coalesce(x["asked"] > 20000, F.lit(False))))
    return one.select("case_id", F.exists("c", lambda x: x["outcome"] == "unclear").alias("some_unclear"), F.forall("c", lambda x: x["role"] == "employee").alias("all_employee"), large.cast("long").alias("large"))


@query("n03_distinct_in_order", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda v, i: list_position(string_split(p_name, ' '), v) = i), ' ') AS words FROM part")
def n03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(F.split("p_name", " ")), " ").alias("words"))


@query("n04_joined", f"WITH {ITEMS} SELECT case_id, string_agg(DISTINCT kind, ';' ORDER BY kind) AS kinds FROM items GROUP BY case_id")
def n04(spark: SparkSession, d: str) -> DataFrame:
    return case_items(spark, d).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("kinds"))


@query("n05_counter_map", "SELECT c_nationkey, string_agg(c_mktsegment || '=' || n, ',' ORDER BY c_mktsegment) AS counts FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY c_nationkey")
def n05(spark: SparkSession, d: str) -> DataFrame:
    """A map of counters for each group, built from counts and not from rows."""
    counts = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    one = counts.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("m"))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return one.select("c_nationkey", F.array_join(entries, ",").alias("counts"))


@query("n06_nested_map", f"WITH {CASES}, s AS (SELECT segment, level, count(*) AS n FROM cases GROUP BY 1, 2) SELECT segment, '{{' || string_agg('\"' || level || '\":' || n, ',' ORDER BY level) || '}}' AS cells FROM s GROUP BY segment")
def n06(spark: SparkSession, d: str) -> DataFrame:
    """A matrix as a map of maps, as JSON."""
    counts = cases(spark, d).groupBy("segment", "level").agg(F.count("*").alias("n"))
    one = counts.groupBy("segment").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("m"))
    return one.select("segment", F.to_json("m").alias("cells"))


@query("n08_json_contract", "SELECT event_id, list_filter([CASE WHEN NOT json_exists(props, '$.k') THEN 'k_missing' END, CASE WHEN json_exists(props, '$.k') AND (props->>'k')::INTEGER > 50 THEN 'k_too_large' END], lambda x: x IS NOT NULL)[1] AS issue FROM events")
def n08(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a JSON value against its contract: missing, unknown or out of range fields."""
    keys, k = F.json_object_keys("props"), F.from_json("props", "k int")["k"]
    extra = F.size(F.array_except(keys, F.array(F.lit("k")))) > 0
    issues = F.array_compact(F.array(F.when(~F.array_contains(keys, "k"), "k_missing"), F.when(k > 50, "k_too_large"), F.when(extra, "unknown_field")))
    return table(spark, d, "events").select("event_id", F.get(issues, F.lit(0)).alias("issue"))


@query("n10_conditional_fields", "SELECT c_custkey, '{\"id\":' || c_custkey || CASE WHEN c_acctbal > 0 THEN ',\"segment\":\"' || c_mktsegment || '\"' ELSE '' END || '}' AS record FROM customer")
def n10(spark: SparkSession, d: str) -> DataFrame:
    """A field that is there under a condition only: JSON leaves nulls out."""
    rows = table(spark, d, "customer")
    return rows.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))).alias("record"))


@query("m15_similarity_blend", f"WITH {CASES}, {ITEMS}, o AS (SELECT list_distinct(list(kind)) AS ks, list_distinct(list(brand)) AS bs FROM items WHERE case_id = 1), x AS (SELECT case_id, list_distinct(list(kind)) AS ks, list_distinct(list(brand)) AS bs FROM items WHERE case_id <> 1 GROUP BY case_id) SELECT case_id, least(99, greatest(10, round(100 * (0.6 * len(list_intersect(x.ks, o.ks)) / len(o.ks) + 0.4 * len(list_intersect(x.bs, o.bs)) / len(o.bs)))))::INTEGER AS score FROM x, o")
def m15(spark: SparkSession, d: str) -> DataFrame:
    """A blend of overlaps with one case, each over that case's own set, between 10 and 99."""
    sets = case_items(spark, d).groupBy("case_id").agg(F.collect_set("kind").alias("ks"), F.collect_set("brand").alias("bs"))
    own = case_items(spark, d).where("case_id = 1").agg(F.collect_set("kind").alias("ks"), F.collect_set("brand").alias("bs")).first()
    if not own["ks"]:
        return sets.select("case_id", F.lit(10).alias("score")).limit(0)
    share = lambda c: F.size(F.array_intersect(c, F.array(*map(F.lit, own[c])))) / len(own[c])
    score = F.least(F.lit(99), F.greatest(F.lit(10), F.round(100 * (0.6 * share("ks") + 0.4 * share("bs")))))
    return sets.where("case_id <> 1").select("case_id", score.cast("int").alias("score"))
