"""Tables of a folder of Parquet files, and the records that the queries run on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, which all executors share; a local session without one takes a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="verdigris-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order: case_id, city, level, segment, year, amount, outcome, party, day."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    outcome = F.when(F.col("o_totalprice") < 20000, "unclear").when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "P", "partially_supported").otherwise("not_supported")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.select(
        F.col("o_orderkey").alias("case_id"), F.col("n_name").alias("city"), F.col("o_orderpriority").alias("level"), F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("amount"), outcome.alias("outcome"), F.col("o_custkey").alias("party"), F.col("o_orderdate").alias("day"),
    )


def case_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct kinds and brands of each case: case_id, kind, brand."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("case_id"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand")).distinct()


#: The same in SQL, for WITH.
CASES = """cases AS (
  SELECT o_orderkey AS case_id, n_name AS city, o_orderpriority AS level, c_mktsegment AS segment, CAST(year(o_orderdate) AS INTEGER) AS year,
         o_totalprice AS amount, o_custkey AS party, o_orderdate AS day,
         CASE WHEN o_totalprice < 20000 THEN 'unclear' WHEN o_orderstatus = 'F' THEN 'supported'
              WHEN o_orderstatus = 'P' THEN 'partially_supported' ELSE 'not_supported' END AS outcome
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
ITEMS = """items AS (SELECT DISTINCT l_orderkey AS case_id, p_type AS kind, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey)"""
COUNTS = """count(*) AS total, count(*) FILTER (WHERE outcome = 'supported') AS supported, count(*) FILTER (WHERE outcome = 'partially_supported') AS partially_supported,
  count(*) FILTER (WHERE outcome = 'not_supported') AS not_supported, count(*) FILTER (WHERE outcome = 'unclear') AS unclear, count(*) FILTER (WHERE outcome <> 'unclear') AS known"""
RATES = """CASE WHEN known > 0 THEN round(supported::DOUBLE / known * 100, 1) END AS win_rate,
  CASE WHEN known > 0 THEN round(partially_supported::DOUBLE / known * 100, 1) END AS partial_rate"""
