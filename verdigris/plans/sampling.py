"""Populations, strata, allocations and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.hashing import row_fingerprint
from verdigris.operators import sampling as sp
from verdigris.plans.registry import query
from verdigris.sources.tables import table

_KEY = "concat_ws('|', 'n=' || coalesce(nullif(trim(c_nationkey::VARCHAR), ''), 'unknown'), 's=' || coalesce(nullif(trim(c_mktsegment), ''), 'unknown'))"
_STRATA = f"strata AS (SELECT {_KEY} AS stratum, count(*) AS size FROM customer GROUP BY 1)"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"))
    return rows.withColumn("stratum", sp.stratum_key("n", "s"))


def _strata(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).groupBy("stratum").agg(F.count("*").alias("size"))


@query("r02_strata", f"WITH {_STRATA} SELECT * FROM strata")
def r02(spark: SparkSession, d: str) -> DataFrame:
    return _strata(spark, d)


@query("r01_hash_sample", "SELECT c_custkey, sha256('seed-1:' || c_custkey) AS sample_key FROM customer ORDER BY sample_key, c_custkey LIMIT 50")
def r01(spark: SparkSession, d: str) -> DataFrame:
    return sp.hash_sample(table(spark, d, "customer").select("c_custkey"), "c_custkey", "seed-1", 50)


@query("r01_shuffle_sample")
def r01_exact(spark: SparkSession, d: str) -> DataFrame:
    """The seeded shuffle, which SQL can't express."""
    ids = sp.shuffle_sample(table(spark, d, "nation"), "n_name", "seed-1", 10)
    return spark.createDataFrame([(k, x) for k, x in enumerate(ids, 1)], "position int, n_name string")


@query(
    "r03_proportional",
    f"""WITH {_STRATA}, e AS (SELECT *, size * 100 / (SELECT sum(size) FROM strata)::DOUBLE AS exact FROM strata), f AS (SELECT *, floor(exact)::BIGINT AS fl FROM e), r AS (SELECT *, row_number() OVER (ORDER BY round(exact - fl, 9) DESC, stratum) AS k FROM f)
    SELECT stratum, size, fl + CASE WHEN k <= 100 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS allocated FROM r""",
)
def r03(spark: SparkSession, d: str) -> DataFrame:
    return sp.proportional(_strata(spark, d), 100)


@query(
    "r04_balanced",
    f"""WITH {_STRATA}, levels AS (SELECT unnest(range(0, 1001)) AS level), fit AS (SELECT level, sum(least(size, level)) AS used FROM strata, levels GROUP BY level), best AS (SELECT max(level) AS level FROM fit WHERE used <= 500),
    a AS (SELECT stratum, size, least(size, (SELECT level FROM best)) AS base FROM strata), spare AS (SELECT 500 - sum(base) AS n FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY size > base ORDER BY stratum) AS k FROM a)
    SELECT stratum, size, base + CASE WHEN size > base AND k <= (SELECT n FROM spare) THEN 1 ELSE 0 END AS allocated FROM r""",
)
def r04(spark: SparkSession, d: str) -> DataFrame:
    return sp.balanced(_strata(spark, d), 500)


@query("r05_stratified_hash", f"WITH {_STRATA}, c AS (SELECT c_custkey, {_KEY} AS stratum FROM customer) SELECT stratum, c_custkey, row_number() OVER (PARTITION BY stratum ORDER BY sha256('seed-2:' || stratum || ':' || c_custkey), c_custkey)::INTEGER AS position FROM c QUALIFY position <= 2")
def r05(spark: SparkSession, d: str) -> DataFrame:
    return sp.stratified_hash_sample(_keyed(spark, d), "c_custkey", _strata(spark, d).withColumn("allocated", F.lit(2)), "seed-2")


@query("r05_stratified_shuffle")
def r05_exact(spark: SparkSession, d: str) -> DataFrame:
    return sp.stratified_shuffle_sample(_keyed(spark, d), "c_custkey", sp.balanced(_strata(spark, d), 300), "seed-2")


@query("m08_row_fingerprint", """SELECT r_regionkey, sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}') AS fingerprint FROM region""")
def m08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select("r_regionkey", row_fingerprint(F.col("r_name"), F.col("r_regionkey")).alias("fingerprint"))


@query("m09_candidate_hash", "SELECT sha256(string_agg(c_custkey::VARCHAR, chr(10) ORDER BY c_custkey::VARCHAR)) AS h, count(*) AS n FROM customer")
def m09(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    return spark.createDataFrame([(sp.candidate_hash(rows, "c_custkey"), rows.count())], "h string, n long")


_WORDS = ", ".join(f"sum(('0x' || substring(x, {8 * k + 1}, 8))::BIGINT)" for k in range(8))


@query("m09_population_hash", f"SELECT sha256(concat_ws(':', {_WORDS})) AS h, count(*) AS n FROM (SELECT sha256(o_orderkey::VARCHAR) AS x FROM orders)")
def m09_any(spark: SparkSession, d: str) -> DataFrame:
    """A population's hash without an order, for any size."""
    return sp.population_hash(table(spark, d, "orders"), "o_orderkey")


@query(
    "a24_snapshot_distributions",
    "SELECT 'segment' AS dimension, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'nation', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY 2",
)
def a24(spark: SparkSession, d: str) -> DataFrame:
    from verdigris.operators.stats import marginals

    return marginals(table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")), "segment", "nation")
