"""Statistics queries: outcome statistics, distributions, rates, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.rates import complement, merged_outcome, percent
from verdigris.operators import stats
from verdigris.plans.registry import query
from verdigris.sources.tables import CASES, COUNTS, ITEMS, RATES, case_items, cases, table


@query("a01_outcome_stats", f"WITH {CASES}, s AS (SELECT city, {COUNTS} FROM cases GROUP BY city) SELECT *, {RATES} FROM s")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return stats.outcome_stats(cases(spark, d), "outcome", "city")


@query("a01_traceback", f"WITH {CASES} SELECT city, outcome, case_id FROM cases")
def a01_ids(spark: SparkSession, d: str) -> DataFrame:
    return stats.traceback(cases(spark, d), "outcome", "case_id", "city")


@query(
    "a02_city_summary",
    f"""WITH {CASES}, s AS (SELECT city, {COUNTS} FROM cases WHERE level = '1-URGENT' AND year = 1995 GROUP BY city), r AS (SELECT *, {RATES} FROM s)
    SELECT n_name AS city, coalesce(total, 0) AS total, coalesce(supported, 0) AS supported, coalesce(partially_supported, 0) AS partially_supported, coalesce(not_supported, 0) AS not_supported,
    coalesce(unclear, 0) AS unclear, coalesce(known, 0) AS known, win_rate, partial_rate FROM nation LEFT JOIN r ON city = n_name""",
)
def a02(spark: SparkSession, d: str) -> DataFrame:
    """Every city of the scope has a row, with zero counts where it has no case."""
    some = cases(spark, d).where((F.col("level") == "1-URGENT") & (F.col("year") == 1995))
    scope = table(spark, d, "nation").select(F.col("n_name").alias("city"))
    return stats.with_scope(stats.outcome_stats(some, "outcome", "city"), scope, "city")


@query(
    "a03_type_summary",
    f"""WITH {CASES}, {ITEMS}, t AS (SELECT DISTINCT case_id, kind FROM items), s AS (SELECT kind, {COUNTS} FROM t JOIN cases USING (case_id) GROUP BY kind) SELECT *, {RATES} FROM s""",
)
def a03(spark: SparkSession, d: str) -> DataFrame:
    """A case counts under each of its kinds."""
    kinds = case_items(spark, d).select("case_id", "kind").distinct()
    return stats.outcome_stats(kinds.join(cases(spark, d), "case_id"), "outcome", "kind")


@query(
    "a04_claim_outcome",
    """WITH s AS (SELECT l_orderkey AS case_id, CASE WHEN l_returnflag = 'A' THEN 'supported' WHEN l_returnflag = 'R' THEN 'not_supported' WHEN l_linestatus = 'F' THEN 'partially_supported' ELSE 'unclear' END AS o FROM lineitem)
    SELECT case_id, CASE WHEN bool_or(o = 'partially_supported') OR (bool_or(o = 'supported') AND bool_or(o = 'not_supported')) THEN 'partially_supported'
    WHEN bool_or(o = 'supported') THEN 'supported' WHEN bool_or(o = 'not_supported') THEN 'not_supported' ELSE 'unclear' END AS outcome FROM s GROUP BY case_id""",
)
def a04(spark: SparkSession, d: str) -> DataFrame:
    """One outcome for each case from its claims; at most four distinct outcomes are gathered."""
    o = F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "R", "not_supported").when(F.col("l_linestatus") == "F", "partially_supported").otherwise("unclear")
    claims = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), o.alias("o"))
    return claims.groupBy("case_id").agg(F.collect_set("o").alias("os")).select("case_id", merged_outcome(F.col("os")).alias("outcome"))


@query(
    "a05_defense_summary",
    f"""WITH {CASES}, l AS (SELECT l_orderkey AS case_id, p_type AS defense FROM lineitem JOIN part ON l_partkey = p_partkey),
    s AS (SELECT defense, count(*) AS frequency, count(DISTINCT case_id) AS case_count, count(DISTINCT case_id) FILTER (WHERE outcome = 'not_supported') AS held,
    count(DISTINCT case_id) FILTER (WHERE outcome <> 'unclear') AS known FROM l JOIN cases USING (case_id) GROUP BY defense)
    SELECT *, CASE WHEN known > 0 THEN round(held::DOUBLE / known * 100, 1) ELSE 0 END AS support_rate FROM s""",
)
def a05(spark: SparkSession, d: str) -> DataFrame:
    """Matching items and cases; partial counts by case come first, so no distinct aggregate is needed."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    items = line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy(F.col("l_orderkey").alias("case_id"), F.col("p_type").alias("defense")).agg(F.count("*").alias("k"))
    out = items.join(cases(spark, d).select("case_id", "outcome"), "case_id").groupBy("defense")
    out = out.agg(F.sum("k").alias("frequency"), F.count("*").alias("case_count"), F.count_if(F.col("outcome") == "not_supported").alias("held"), F.count_if(F.col("outcome") != "unclear").alias("known"))
    return out.select("*", percent(F.col("held"), F.col("known"), none=0.0).alias("support_rate"))


@query(
    "a06_evidence_prevalence",
    f"""WITH {CASES}, {ITEMS}, p AS (SELECT case_id FROM cases WHERE outcome = 'supported' AND case_id IN (SELECT case_id FROM items)), c AS (SELECT DISTINCT case_id, brand FROM items JOIN p USING (case_id))
    SELECT brand, count(*) AS cases, (SELECT count(*) FROM p) AS population, round(count(*)::DOUBLE / (SELECT count(*) FROM p) * 100, 1) AS prevalence FROM c GROUP BY brand""",
)
def a06(spark: SparkSession, d: str) -> DataFrame:
    rows = case_items(spark, d).join(cases(spark, d).select("case_id", "outcome"), "case_id")
    return stats.prevalence(rows, "case_id", "brand", F.col("outcome") == "supported")


@query(
    "a07_report_header",
    f"""WITH {CASES} SELECT count(*) AS total, count(*) FILTER (WHERE outcome <> 'unclear') AS included, count(*) FILTER (WHERE outcome = 'unclear') AS excluded,
    round(avg(case_id % 101), 1) AS mean_score, count(*) FILTER (WHERE level = '1-URGENT') AS urgent, count(*) FILTER (WHERE level = '5-LOW') AS low FROM cases""",
)
def a07(spark: SparkSession, d: str) -> DataFrame:
    clear = F.col("outcome") != "unclear"
    return cases(spark, d).agg(
        F.count("*").alias("total"), F.count_if(clear).alias("included"), F.count_if(~clear).alias("excluded"), F.round(F.avg(F.col("case_id") % 101), 1).alias("mean_score"),
        F.count_if(F.col("level") == "1-URGENT").alias("urgent"), F.count_if(F.col("level") == "5-LOW").alias("low"),
    )


@query(
    "a09_missing_checklist",
    f"""WITH {CASES}, {ITEMS}, p AS (SELECT case_id FROM cases WHERE outcome IN ('not_supported', 'partially_supported')), k AS (SELECT unnest(['Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5']) AS item),
    h AS (SELECT brand AS item, count(DISTINCT case_id) AS n FROM items JOIN p USING (case_id) GROUP BY brand)
    SELECT item, (SELECT count(*) FROM p) - coalesce(n, 0) AS missing, round(((SELECT count(*) FROM p) - coalesce(n, 0))::DOUBLE / (SELECT count(*) FROM p) * 100, 1) AS rate FROM k LEFT JOIN h USING (item)""",
)
def a09(spark: SparkSession, d: str) -> DataFrame:
    """How many failed cases lack each item of a checklist: all of them less those that have it, so nothing is crossed."""
    failed = cases(spark, d).where(F.col("outcome").isin("not_supported", "partially_supported")).select("case_id")
    total = failed.count()
    have = case_items(spark, d).join(failed, "case_id").select("case_id", F.col("brand").alias("item")).distinct().groupBy("item").agg(F.count("*").alias("n"))
    checklist = spark.createDataFrame([(f"Brand#{k}",) for k in range(1, 6)], "item string")
    missing = F.lit(total) - F.coalesce("n", F.lit(0))
    return checklist.join(have, "item", "left").select("item", missing.cast("long").alias("missing"), percent(missing, F.lit(total), none=0.0).alias("rate"))


@query(
    "a12_overview",
    f"""WITH {CASES}, s AS (SELECT count(*) AS n, count(DISTINCT city) AS cities, min(year) AS first_year, max(year) AS last_year, round(sum(amount::DECIMAL(18, 2))::DOUBLE, 2) AS amount, count(*) FILTER (WHERE outcome = 'supported') AS won, count(*) FILTER (WHERE outcome <> 'unclear') AS known FROM cases)
    SELECT n, cities, first_year, last_year, amount, round(won::DOUBLE / known * 100, 1) AS win_rate, (SELECT segment FROM cases GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1) AS top_segment FROM s""",
)
def a12(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d)
    top = rows.groupBy("segment").count().orderBy(F.desc("count"), "segment").first()
    return rows.agg(
        F.count("*").alias("n"), F.count_distinct("city").alias("cities"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.round(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double"), 2).alias("amount"),
        percent(F.count_if(F.col("outcome") == "supported"), F.count_if(F.col("outcome") != "unclear")).alias("win_rate"), F.lit(top["segment"] if top else None).alias("top_segment"),
    )


@query("a13_by_year", f"WITH {CASES}, s AS (SELECT year, {COUNTS} FROM cases GROUP BY year) SELECT *, {RATES} FROM s")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return stats.outcome_stats(cases(spark, d), "outcome", "year")


@query(
    "a14_tag_distribution",
    f"WITH {ITEMS}, t AS (SELECT DISTINCT case_id, kind FROM items), n AS (SELECT count(DISTINCT case_id) AS n FROM t) SELECT kind, count(*) AS n, round(count(*)::DOUBLE / (SELECT n FROM n) * 100, 1) AS share FROM t GROUP BY kind",
)
def a14(spark: SparkSession, d: str) -> DataFrame:
    tagged = case_items(spark, d).groupBy("case_id").agg(F.collect_set("kind").alias("kinds"))
    return stats.array_distribution(tagged, "kinds", "kind")


@query("a14_decision_distribution", f"WITH {CASES} SELECT outcome, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM cases) * 100, 1) AS share FROM cases GROUP BY outcome")
def a14_decisions(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution(cases(spark, d), "outcome", "outcome")


@query(
    "a16_score_bands",
    "WITH s AS (SELECT CASE WHEN event_id % 101 >= 80 THEN 'high' WHEN event_id % 101 >= 60 THEN 'medium' ELSE 'low' END AS band FROM events) SELECT band, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM s) * 100, 1) AS share FROM s GROUP BY band",
)
def a16(spark: SparkSession, d: str) -> DataFrame:
    return stats.score_bands(table(spark, d, "events").select((F.col("event_id") % 101).alias("score")), "score", {"high": 80, "medium": 60}, "low")


@query(
    "a16_fill_rates",
    """WITH l AS (SELECT d.doc_id, d.text, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)), s AS (SELECT count(*) AS n, count(nullif(trim(text), '')) AS text, count(quality) AS quality, count(toxic) AS toxic FROM l)
    SELECT f.field, n, f.filled, round(f.filled::DOUBLE / n * 100, 1) AS share FROM s, LATERAL (SELECT unnest(['text', 'quality', 'toxic']) AS field, unnest([text, quality, toxic]) AS filled) f""",
)
def a16_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id", "left")
    return stats.fill_rates(rows, "text", "quality", "toxic")


@query(
    "a23_dataset_marginals",
    f"""WITH {CASES} SELECT 'city' AS dimension, city AS value, count(*) AS n FROM cases GROUP BY city UNION ALL SELECT 'level', level, count(*) FROM cases GROUP BY level
    UNION ALL SELECT 'year', year::VARCHAR, count(*) FROM cases GROUP BY year UNION ALL SELECT 'outcome', outcome, count(*) FROM cases GROUP BY outcome""",
)
def a23(spark: SparkSession, d: str) -> DataFrame:
    return stats.marginals(cases(spark, d), "city", "level", "year", "outcome")


@query(
    "a25_guardrails",
    f"""WITH {CASES}, s AS (SELECT city, year, count(*) AS n, count(*) FILTER (WHERE outcome = 'unclear') AS unknown FROM cases GROUP BY city, year)
    SELECT city, year, n, unknown, array_to_string(list_filter([CASE WHEN n < 30 THEN 'SMALL_SAMPLE' END, CASE WHEN unknown::DOUBLE / n > 0.10 THEN 'HIGH_UNKNOWN_RATE' END], lambda x: x IS NOT NULL), ',') AS issues,
    CASE WHEN n < 30 OR unknown::DOUBLE / n > 0.10 THEN 'warning' ELSE 'pass' END AS status FROM s""",
)
def a25(spark: SparkSession, d: str) -> DataFrame:
    return stats.guardrails(cases(spark, d), "outcome", "city", "year")


@query(
    "a26_coverage_audit",
    f"""WITH {CASES}, x AS (SELECT 'outcome' AS kind, outcome AS value FROM cases UNION ALL SELECT 'reason', CASE WHEN outcome = 'unclear' THEN 'no_amount' WHEN level = '4-NOT SPECIFIED' THEN 'no_level' END FROM cases)
    SELECT kind, value, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM cases) * 1000) / 10 AS share FROM x WHERE value IS NOT NULL GROUP BY kind, value""",
)
def a26(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("outcome") == "unclear", "no_amount").when(F.col("level") == "4-NOT SPECIFIED", "no_level")
    return stats.coverage_audit(cases(spark, d).withColumn("reason", reason), "outcome", "reason")


_GOLD = """g AS (SELECT doc_id, quality AS gold, lang, CASE WHEN n_chars < 100 THEN NULL WHEN n_chars % 5 = 0 THEN 0 ELSE 1 END AS predicted FROM labels JOIN documents USING (doc_id))"""
_METRICS = """count(*) AS eligible, count(predicted) AS definite, count(*) FILTER (WHERE gold = predicted) AS correct, count(*) FILTER (WHERE gold <> predicted) AS incorrect,
 CASE WHEN count(*) > 0 THEN round(count(predicted)::DOUBLE / count(*) * 100, 1) ELSE 0 END AS coverage, CASE WHEN count(predicted) > 0 THEN round((count(*) FILTER (WHERE gold = predicted))::DOUBLE / count(predicted) * 100, 1) ELSE 0 END AS accuracy,
 CASE WHEN count(*) > 0 THEN round((count(*) FILTER (WHERE gold = predicted))::DOUBLE / count(*) * 100, 1) ELSE 0 END AS end_to_end"""


@query("a28_gold_metrics", f"WITH {_GOLD} SELECT {_METRICS} FROM g WHERE gold IS NOT NULL")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return stats.agreement(_gold(spark, d), F.col("gold"), F.col("predicted"))


@query("a29_benchmark_rollup", f"WITH {_GOLD} SELECT lang, {_METRICS} FROM g WHERE gold IS NOT NULL GROUP BY ROLLUP (lang)")
def a29(spark: SparkSession, d: str) -> DataFrame:
    """By language and over all (null), in one pass."""
    return stats.agreement(_gold(spark, d), F.col("gold"), F.col("predicted"), "lang")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    predicted = F.when(F.col("n_chars") < 100, None).when(F.col("n_chars") % 5 == 0, 0).otherwise(1)
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("gold"), "lang", predicted.alias("predicted"))


@query("a30_reason_histogram", "SELECT w AS reason, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def a30(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "a34_funnel",
    f"""WITH {CASES}, s AS (SELECT count(*) AS a, count(*) FILTER (WHERE amount >= 20000) AS b, count(*) FILTER (WHERE amount >= 20000 AND outcome <> 'unclear' AND level <> '4-NOT SPECIFIED') AS c, count(*) FILTER (WHERE amount >= 20000 AND level <> '4-NOT SPECIFIED' AND year >= 1995) AS e FROM cases)
    SELECT f.* FROM s, LATERAL (SELECT unnest(['scanned', 'parsed', 'clear', 'recent']) AS layer, unnest([0, 1, 2, 3])::INTEGER AS position, unnest([a, b, c, e]) AS n, unnest([CASE WHEN a > 0 THEN 100.0::DOUBLE ELSE 0 END, CASE WHEN a > 0 THEN round(b::DOUBLE / a * 100, 1) ELSE 0 END, CASE WHEN b > 0 THEN round(c::DOUBLE / b * 100, 1) ELSE 0 END, CASE WHEN c > 0 THEN round(e::DOUBLE / c * 100, 1) ELSE 0 END]) AS rate) f""",
)
def a34(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return stats.funnel(cases(spark, d), scanned=F.lit(True), parsed=c("amount") >= 20000, clear=(c("outcome") != "unclear") & (c("level") != "4-NOT SPECIFIED"), recent=c("year") >= 1995)


@query("a36_library_coverage", f"WITH {CASES} SELECT count(*) AS n, count(DISTINCT city) AS cities, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS years, count(*) FILTER (WHERE year NOT IN (1995, 1996, 1997)) AS other_years FROM cases")
def a36(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).agg(F.count("*").alias("n"), F.count_distinct("city").alias("cities"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("year").alias("years"), F.count_if(~F.col("year").isin(1995, 1996, 1997)).alias("other_years"))


@query(
    "a37_role_outcomes",
    f"""WITH {CASES}, s AS (SELECT party, bool_or(outcome = 'supported') AS s, bool_or(outcome = 'not_supported') AS n, bool_or(outcome = 'partially_supported') AS p, bool_or(outcome = 'unclear') AS u FROM cases GROUP BY party),
    o AS (SELECT party, CASE WHEN p OR (s AND n) THEN 'partially_supported' WHEN s THEN 'supported' WHEN n THEN 'not_supported' ELSE 'unclear' END AS applicant, u FROM s)
    SELECT party, applicant, CASE WHEN u THEN 'unclear' ELSE applicant END AS strict, CASE applicant WHEN 'supported' THEN 'not_supported' WHEN 'not_supported' THEN 'supported' ELSE applicant END AS respondent FROM o""",
)
def a37(spark: SparkSession, d: str) -> DataFrame:
    """A party's outcome over its cases, under two policies for unclear ones, and the other side's."""
    one = cases(spark, d).groupBy("party").agg(F.collect_set("outcome").alias("os"))
    out = one.select("party", merged_outcome(F.col("os")).alias("applicant"), merged_outcome(F.col("os"), "any_unclear").alias("strict"))
    return out.withColumn("respondent", complement(F.col("applicant")))
