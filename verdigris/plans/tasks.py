"""Queries of tasks for reviewers and models, their contracts and hand-over, labels, and small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions.hashing import Generator, seed_of_stratum
from verdigris.functions.text import terms
from verdigris.operators import keyed
from verdigris.operators import provenance as pv
from verdigris.operators import sampling as sp
from verdigris.plans.registry import query
from verdigris.sources.records import CLAIMS, claims
from verdigris.sources.tables import CASES, ITEMS, case_items, cases, table

_FILTER = "lambda x: x IS NOT NULL"


@query("p09_task_targets", f"WITH {CLAIMS}, u AS (SELECT DISTINCT case_id, kind FROM claims WHERE outcome = 'unclear' AND asked IS NOT NULL) SELECT case_id, string_agg(kind, ',' ORDER BY kind) AS targets, count(*) AS n FROM u GROUP BY case_id")
def p09(spark: SparkSession, d: str) -> DataFrame:
    """A task for each case with open claims: its distinct targets."""
    rows = claims(spark, d).where((F.col("outcome") == "unclear") & F.col("asked").isNotNull())
    out = rows.groupBy("case_id").agg(F.array_sort(F.collect_set("kind")).alias("t"))
    return out.select("case_id", F.array_join("t", ",").alias("targets"), F.size("t").cast("long").alias("n"))


@query("p10_clipped_inputs", "SELECT doc_id, lang, length(substring(text, 1, 400)) AS n_short, length(substring(text, 1, 1200)) AS n_long, length(text) > 1200 AS clipped FROM documents")
def p10(spark: SparkSession, d: str) -> DataFrame:
    """What a model may see of a document: named fields only, each clipped to its length."""
    n = lambda k: F.length(F.substring("text", 1, k)).cast("long")
    return table(spark, d, "documents").select("doc_id", "lang", n(400).alias("n_short"), n(1200).alias("n_long"), (F.length("text") > 1200).alias("clipped"))


LABELS = {"wages": "工资", "overtime": "加班工资", "leave": "年休假工资"}


@query("p13_display_labels", f"WITH {CLAIMS} SELECT CASE kind WHEN 'wages' THEN '工资' WHEN 'overtime' THEN '加班工资' WHEN 'leave' THEN '年休假工资' ELSE kind END AS label, count(*) AS n FROM claims GROUP BY 1")
def p13(spark: SparkSession, d: str) -> DataFrame:
    """Labels by name; what has none shows its own name."""
    labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return claims(spark, d).groupBy(F.coalesce(F.try_element_at(labels, F.col("kind")), F.col("kind")).alias("label")).agg(F.count("*").alias("n"))


@query("p18_run_state", "WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type IN ('error', 'purchase')) SELECT u.user_id, coalesce(CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' END, 'pending') AS state FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN e ON e.user_id = u.user_id AND k = 1")
def p18(spark: SparkSession, d: str) -> DataFrame:
    """Each run's state from its latest result; one without any is pending."""
    events = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    last = keyed.latest(events.where(F.col("event_type").isin("error", "purchase")), ["user_id"], "ts", "event_id")
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    return events.select("user_id").distinct().join(last, "user_id", "left").select("user_id", state.alias("state"))


_AUDIT = f"list_filter([CASE WHEN awarded > asked THEN 'AWARD_EXCEEDS_REQUEST' END, CASE WHEN outcome = 'supported' AND asked IS NULL THEN 'MISSING_REQUEST' END, CASE WHEN outcome = 'partially_supported' AND provider = 'unknown' THEN 'EVIDENCE_MISSING' END, CASE WHEN outcome = 'unclear' THEN 'OUTCOME_UNCLEAR' END], {_FILTER})"


def audit():
    c = F.col
    return pv.issues(AWARD_EXCEEDS_REQUEST=c("awarded") > c("asked"), MISSING_REQUEST=(c("outcome") == "supported") & c("asked").isNull(), EVIDENCE_MISSING=(c("outcome") == "partially_supported") & (c("provider") == "unknown"), OUTCOME_UNCLEAR=c("outcome") == "unclear")


@query("r14_semantic_audit", f"WITH {CLAIMS} SELECT case_id, claim_id, array_to_string({_AUDIT}, ',') AS reasons FROM claims")
def r14(spark: SparkSession, d: str) -> DataFrame:
    """All reasons against a result."""
    return claims(spark, d).select("case_id", "claim_id", F.array_join(audit(), ",").alias("reasons"))


@query(
    "r15_task_contract",
    f"WITH {CLAIMS}, e AS (SELECT DISTINCT case_id, kind FROM claims WHERE outcome = 'unclear'), g AS (SELECT case_id, kind, count(*) AS n FROM claims WHERE case_id % 3 <> 0 AND claim_id <> 2 GROUP BY case_id, kind) SELECT CASE WHEN g.n IS NULL THEN 'uncovered' WHEN e.kind IS NULL THEN 'extra' WHEN g.n > 1 THEN 'duplicate' ELSE 'covered' END AS state, count(*) AS n FROM e FULL JOIN g ON e.case_id = g.case_id AND e.kind = g.kind GROUP BY 1",
)
def r15(spark: SparkSession, d: str) -> DataFrame:
    """Results against the targets of their task: covered, missing, twice or not asked for."""
    rows = claims(spark, d)
    expected = rows.where("outcome = 'unclear'").select("case_id", "kind", F.lit(True).alias("wanted")).distinct()
    got = rows.where("case_id % 3 <> 0 AND claim_id <> 2").groupBy("case_id", "kind").agg(F.count("*").alias("given"))
    both = expected.join(got, ["case_id", "kind"], "full")
    state = F.when(F.col("given").isNull(), "uncovered").when(F.col("wanted").isNull(), "extra").when(F.col("given") > 1, "duplicate").otherwise("covered")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("r18_two_stage", f"WITH {CLAIMS} SELECT CASE WHEN claim_id % 4 = 0 THEN 'relationship_failed' WHEN outcome = 'unclear' THEN 'outcome_failed' ELSE 'resolved' END AS attribution, count(*) AS n FROM claims GROUP BY 1")
def r18(spark: SparkSession, d: str) -> DataFrame:
    """Which of two stages a failure comes from: the relation, or the outcome given the relation."""
    stage = F.when(F.col("claim_id") % 4 == 0, "relationship_failed").when(F.col("outcome") == "unclear", "outcome_failed").otherwise("resolved")
    return claims(spark, d).groupBy(stage.alias("attribution")).agg(F.count("*").alias("n"))


@query("r25_hand_over", f"WITH {CLAIMS}, s AS (SELECT CASE WHEN case_id % 17 = 0 THEN 'technical_failure' WHEN asked IS NULL AND awarded IS NOT NULL THEN 'contract_failed' WHEN len({_AUDIT}) > 0 THEN 'review' ELSE 'accepted' END AS state FROM claims) SELECT state, count(*) AS n FROM s GROUP BY state")
def r25(spark: SparkSession, d: str) -> DataFrame:
    """Results by the first stage that stops them; only a failed audit goes to a reviewer."""
    state = F.when(F.col("case_id") % 17 == 0, "technical_failure").when(F.col("asked").isNull() & F.col("awarded").isNotNull(), "contract_failed").when(F.size(audit()) > 0, "review").otherwise("accepted")
    return claims(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("r26_manual_items", f"WITH {CLAIMS} SELECT case_id, count(*) AS n_claims, 'unclear' AS outcome, 0.0::DOUBLE AS confidence FROM claims GROUP BY case_id HAVING bool_and(outcome = 'unclear' OR asked IS NULL)")
def r26(spark: SparkSession, d: str) -> DataFrame:
    """An item to fill in by hand for each case of which no claim has a result: all claims unclear, no confidence."""
    failed = (F.col("outcome") == "unclear") | F.col("asked").isNull()
    return claims(spark, d).groupBy("case_id").agg(F.count("*").alias("n_claims"), F.bool_and(failed).alias("failed")).where("failed").select("case_id", "n_claims", F.lit("unclear").alias("outcome"), F.lit(0.0).alias("confidence"))


@query("s15_scanned_texts", "SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 50 THEN 'scanned' ELSE 'text' END AS kind FROM documents")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose pages gave under 50 characters are taken to be scans."""
    return table(spark, d, "documents").select("doc_id", F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) < 50, "scanned").otherwise("text").alias("kind"))


@query("s17_demo_source", "SELECT unnest(range(1, 6)) AS case_id, 'synthetic' AS source")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """Made-up rows, marked as such."""
    return spark.range(1, 6).select(F.col("id").alias("case_id"), F.lit("synthetic").alias("source"))


@query("s18_source_dispatch", "SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN length(text) ELSE len(string_split(text, chr(10))) END AS size FROM documents")
def s18(spark: SparkSession, d: str) -> DataFrame:
    """Each source read by its own parser: a parser is an expression, so all sources are one pass."""
    parsers = [(F.startswith("source", F.lit("src1")), F.length("text"))]
    out = F.size(F.split("text", "\n"))
    for handles, parse in reversed(parsers):
        out = F.when(handles, parse).otherwise(out)
    return table(spark, d, "documents").select("doc_id", out.cast("long").alias("size"))


@query("k11_settings", "SELECT unnest(['model', 'page_size', 'theme']) AS name, unnest(['b', '50', 'dark']) AS value")
def k11(spark: SparkSession, d: str) -> DataFrame:
    """Settings by name; a new value takes the place of the old one."""
    old = spark.createDataFrame([("model", "a"), ("page_size", "50")], "name string, value string")
    return keyed.merge_last(old, spark.createDataFrame([("model", "b"), ("theme", "dark")], "name string, value string"), "name")


@query("f17_combined_filters", f"WITH {CASES}, {ITEMS} SELECT case_id FROM cases WHERE year BETWEEN 1994 AND 1996 AND contains(lower(city), 'nation_1') AND case_id IN (SELECT case_id FROM items WHERE brand IN ('Brand#1', 'Brand#2')) AND outcome <> 'unclear'")
def f17(spark: SparkSession, d: str) -> DataFrame:
    """The filters of a screen together: years, a word, tags, a known outcome."""
    tagged = case_items(spark, d).where(F.col("brand").isin("Brand#1", "Brand#2")).select("case_id").distinct()
    rows = cases(spark, d).where(F.col("year").between(1994, 1996) & F.contains(F.lower("city"), F.lit("nation_1")) & (F.col("outcome") != "unclear"))
    return rows.join(tagged, "case_id", "left_semi").select("case_id")


@query("m06_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def m06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("m11_generator")
def m11(spark: SparkSession, d: str) -> DataFrame:
    """The first numbers of the generator behind seeded samples, for three seeds."""
    rows = []
    for seed in ("1", "legal", "深圳"):
        draw = Generator(seed)
        rows += [(seed, k, draw()) for k in range(5)]
    return spark.createDataFrame(rows, "seed string, position int, value double")


@query("m12_stratum_seeds", """SELECT c_mktsegment AS stratum, 'stratum-seed-v1:' || sha256('{"algorithmVersion":"stratified-seeded-v1","globalSeed":"seed-9","stratumKey":"' || c_mktsegment || '"}') AS seed FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def m12(spark: SparkSession, d: str) -> DataFrame:
    """A seed of its own for each stratum."""
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("stratum")).distinct().select("stratum", seed_of_stratum("seed-9", F.col("stratum"), sp.ALGORITHM).alias("seed"))


@query("n01_explode", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def n01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query(
    "t11_cosine",
    r"""WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark), t AS (SELECT item_id, term, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2), norm AS (SELECT item_id, sqrt(sum(n * n)) AS n FROM t GROUP BY item_id)
    SELECT a.item_id, round(coalesce((SELECT sum(x.n * y.n) FROM t x JOIN t y USING (term) WHERE x.item_id = a.item_id AND y.item_id = a.item_id + 1), 0) / (a.n * b.n), 6) AS cosine FROM norm a JOIN norm b ON b.item_id = a.item_id + 1""",
)
def t11(spark: SparkSession, d: str) -> DataFrame:
    """The cosine of the term counts of each item and the next, in the row: the words of both are sorted runs."""
    items = table(spark, d, "benchmark").select("item_id", terms(F.col("text")).alias("w")).where(F.size("w") > 0)
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    n = lambda words, x: F.size(F.filter(words, lambda y: y == x)).cast("double")
    dot = lambda a, b: F.aggregate(F.array_distinct(a), F.lit(0.0), lambda s, x: s + n(a, x) * n(b, x))
    return items.join(after, "item_id").select("item_id", F.round(dot("w", "v") / F.sqrt(dot("w", "w") * dot("v", "v")), 6).alias("cosine"))


@query("w07_largest_remainder", "WITH s AS (SELECT p_brand AS stratum, count(*) AS size FROM part GROUP BY 1), e AS (SELECT *, size * 37 / (SELECT sum(size) FROM s)::DOUBLE AS exact FROM s), f AS (SELECT *, floor(exact)::BIGINT AS fl FROM e), r AS (SELECT *, row_number() OVER (ORDER BY round(exact - fl, 9) DESC, stratum) AS k FROM f) SELECT stratum, fl + CASE WHEN k <= 37 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS allocated FROM r")
def w07(spark: SparkSession, d: str) -> DataFrame:
    """37 seats shared out by size, the largest remainders first; a row for each stratum, so one window does."""
    sizes = table(spark, d, "part").groupBy(F.col("p_brand").alias("stratum")).agg(F.count("*").alias("size"))
    return sp.proportional(sizes, 37).select("stratum", "allocated")


@query("stream_state_counters", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, max(ts) AS last FROM events GROUP BY user_id")
def counters(spark: SparkSession, d: str) -> DataFrame:
    """The running counters of each user; the same function serves a stream, where they are its state."""
    from verdigris.streaming.events import running_counters

    return running_counters(table(spark, d, "events"))


@query("stream_first_of_key", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def first_of_key(spark: SparkSession, d: str) -> DataFrame:
    """Events by key, the first of each; on a stream ``deduplicated`` keeps those that come first."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("stream_attributed_join", "SELECT p.event_id, count(*) AS clicks FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts <= p.ts AND c.ts > p.ts - INTERVAL '1 hour' WHERE p.event_type = 'purchase' AND c.event_type = 'click' GROUP BY p.event_id")
def attributed(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with the clicks of the hour before; the condition bounds the state of a stream's join."""
    from verdigris.streaming.events import within_before

    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    pairs = within_before(events.where("event_type = 'purchase'"), events.where("event_type = 'click'"), "user_id", "1 hour")
    return pairs.groupBy("event_id").agg(F.count("*").alias("clicks"))


@query("w10_rank_in_group", f"WITH {CASES} SELECT city, case_id, rank() OVER (PARTITION BY city ORDER BY amount DESC)::INTEGER AS place FROM cases QUALIFY place <= 3")
def w10(spark: SparkSession, d: str) -> DataFrame:
    """The three largest amounts of each city, ties sharing a place."""
    return cases(spark, d).select("city", "case_id", F.rank().over(Window.partitionBy("city").orderBy(F.desc("amount"))).alias("place")).where("place <= 3")
