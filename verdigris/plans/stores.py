"""Queries of stored tables, lookups, paged sources, observed runs and trees of hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import progress
from verdigris.operators import sampling as sp
from verdigris.plans.imports import _bodies
from verdigris.plans.registry import query
from verdigris.sources import paged
from verdigris.sources.stored import StoredTable
from verdigris.sources.tables import scratch, table


def _stored(spark: SparkSession, d: str) -> StoredTable:
    """The customers as a stored table."""
    t = StoredTable(spark, scratch(spark, "stored"))
    t.create(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), ["c_custkey"])
    return t


def _balances(spark: SparkSession, d: str) -> DataFrame:
    """What the orders of a customer come to, under the customer's key; every key that has orders, and one beyond."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    return o.select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("orders "), "n").alias("c_name"), (F.col("last") % 25).cast("int").alias("c_nationkey"), F.col("n").cast("double").alias("c_acctbal"))


_BALANCES = "b AS (SELECT o_custkey AS c_custkey, 'orders ' || count(*) AS c_name, (max(o_orderkey) % 25)::INTEGER AS c_nationkey, count(*)::DOUBLE AS c_acctbal FROM orders GROUP BY o_custkey)"


@query("k01_stored_upsert", f"WITH {_BALANCES} SELECT * FROM b UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM b)")
def k01(spark: SparkSession, d: str) -> DataFrame:
    """A stored table after new rows took the place of old ones with their key."""
    t = _stored(spark, d)
    t.upsert(_balances(spark, d))
    return t.read()


@query("k04_stored_delete", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def k04(spark: SparkSession, d: str) -> DataFrame:
    """A stored table without the customers who have an open order."""
    t = _stored(spark, d)
    t.delete(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct())
    return t.read()


@query("k06_stored_versions", f"WITH {_BALANCES}, n AS (SELECT count(*) AS n, round(sum(c_acctbal::DECIMAL(18, 2)), 2)::DOUBLE AS total FROM (SELECT c_custkey, c_acctbal FROM b UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM b))) SELECT 1 AS version, count(*) AS n, round(sum(c_acctbal::DECIMAL(18, 2)), 2)::DOUBLE AS total FROM customer UNION ALL SELECT 2, n, total FROM n")
def k06(spark: SparkSession, d: str) -> DataFrame:
    """Both versions of a table that was changed: a reader of the old one keeps it whole."""
    t = _stored(spark, d)
    t.upsert(_balances(spark, d))
    sums = [t.read(v).agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("total")) for v in t.versions()]
    return sums[0].unionByName(sums[1])


@query("s03_key_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)")
def s03(spark: SparkSession, d: str) -> DataFrame:
    """The customers of the ten dearest orders, from the buckets of their keys alone."""
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_custkey").distinct().collect()  # ten at most
    return _stored(spark, d).lookup(*((r[0],) for r in top)).select("c_custkey", "c_name")


@query("s06_paged_source", "SELECT c_custkey // 50 AS page, c_custkey AS id, c_name AS name, (SELECT count(*) FROM customer) AS total, NULL::VARCHAR AS error FROM customer WHERE c_custkey // 50 % 7 <> 3 UNION ALL SELECT DISTINCT c_custkey // 50, NULL, NULL, NULL, 'malformed' FROM customer WHERE c_custkey // 50 % 7 = 3")
def s06(spark: SparkSession, d: str) -> DataFrame:
    """Recorded pages through the paged source, a partition each; failed ones stay as rows."""
    folder = scratch(spark, "pages")
    _bodies(spark, d).select("page", F.col("body").alias("value")).repartition("page").write.partitionBy("page").text(folder)
    spark.dataSource.register(paged.PagedSource)
    rows = spark.read.format("paged").load(folder)
    return rows.select("page", F.get_json_object("row", "$.id").cast("long").alias("id"), F.get_json_object("row", "$.name").alias("name"), "total", "error")


@query("a33_observed_run", "SELECT count(*) AS rows, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS empty, count(*) FILTER (WHERE length(text) > 2000) AS long, count(*) FILTER (WHERE lang = 'en') AS english, count(DISTINCT md5(text)) AS texts FROM documents")
def a33(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a run taken while its rows go by, beside what the run itself makes of them."""
    docs = table(spark, d, "documents").select("lang", "text")
    watched, counts = progress.counted(docs, "run", empty=F.coalesce(F.trim("text"), F.lit("")) == "", long=F.length("text") > 2000, english=F.col("lang") == "en")
    texts = watched.groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n")).where("h IS NOT NULL").count()  # the work: one pass
    got = counts()
    return spark.createDataFrame([(got["rows"], got["empty"], got["long"], got["english"], texts)], "rows long, empty long, long long, english long, texts long")


_BLOCK = "('0x' || substring(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % greatest(1, ((SELECT count(DISTINCT o_orderkey) FROM orders) + 4095) // 4096)"


@query("m09_tree_hash", f"WITH b AS (SELECT {_BLOCK} AS block, sha256(string_agg(DISTINCT o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey::VARCHAR)) AS h FROM orders GROUP BY 1) SELECT CASE WHEN count(*) = 1 THEN any_value(h) ELSE sha256(string_agg(h, chr(10) ORDER BY block)) END AS h, (SELECT count(DISTINCT o_orderkey) FROM orders) AS n, CASE WHEN count(*) = 1 THEN 1 ELSE 2 END AS levels FROM b")
def m09(spark: SparkSession, d: str) -> DataFrame:
    """The hash of an ordered population of any size, as a tree."""
    return sp.tree_hash(table(spark, d, "orders"), "o_orderkey")
