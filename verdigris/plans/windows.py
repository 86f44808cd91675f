"""Queries by key and by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import keyed
from verdigris.plans.registry import query
from verdigris.sources.tables import table
from verdigris.streaming import events as ev


@query("w01_latest_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return keyed.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").drop("ts")


@query("w02_attempts", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS attempt FROM events WHERE event_type = 'error'")
def w02(spark: SparkSession, d: str) -> DataFrame:
    return keyed.attempts(table(spark, d, "events").where("event_type = 'error'"), "user_id", "ts", "event_id", bucket=F.to_date("ts")).select("event_id", "attempt")


@query(
    "w03_carry_forward",
    """WITH p AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS part, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)
    SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id, part ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM p""",
)
def w03(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase's value since the last signup."""
    rows = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return keyed.carry_forward(rows, "user_id", "event_id", "v", F.col("event_type") == "signup", bucket=F.floor(F.col("event_id") / 1000)).select("event_id", "carried")


@query("w05_first_n", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS position FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return keyed.first_n(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", 5, F.col("ts"), F.col("event_id")).select("user_id", "event_id", "position")


@query("w06_first_wins", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def w06(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("text", "doc_id")
    return keyed.best_per_key(rows, ["text"], F.col("doc_id"))


@query("w09_positions", "SELECT conv_id, turn, (unnest(range(len(string_split(text, chr(10))))))::INTEGER AS pos, unnest(list_transform(string_split(text, chr(10)), lambda x: length(x)))::INTEGER AS n FROM conversations")
def w09(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("conv_id", "turn", "pos", F.length("line").alias("n"))


@query("k12_bounded_log", "SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10) GROUP BY user_id")
def k12(spark: SparkSession, d: str) -> DataFrame:
    """The newest ten entries of each log."""
    return keyed.first_n(table(spark, d, "events"), "user_id", 10, F.desc("ts"), F.desc("event_id")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value::DECIMAL(18, 2))::DOUBLE, 2) AS total FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ev.tumbling(table(spark, d, "events"), "1 hour")


@query("stream_sliding", "SELECT s AS start, event_type, count(*) AS n, round(sum(value::DECIMAL(18, 2))::DOUBLE, 2) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1, 2")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    return ev.tumbling(table(spark, d, "events"), "1 hour", "30 minutes")


@query(
    "stream_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(table(spark, d, "events"), "30 minutes")
