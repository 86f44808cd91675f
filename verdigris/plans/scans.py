"""Lookups, filters, sorts, pages and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.text import matches_query
from verdigris.operators import filters, keyed
from verdigris.plans.registry import query
from verdigris.sources.tables import CASES, ITEMS, case_items, cases, table


@query("s01_full_scan", "SELECT count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders")
def s01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("s02_point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def s02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderkey") == 7).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("s03_secondary_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def s03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_nationkey = 3").select("c_custkey", "c_name")


@query("s04_latest", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 6")
def s04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(6).select("o_orderkey", "o_orderdate")


@query("s05_first_match_per_id", "SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3 AND o_orderstatus = 'F' GROUP BY c_custkey")
def s05(spark: SparkSession, d: str) -> DataFrame:
    """The first matching record of each requested id."""
    ids = table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey")
    found = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return keyed.best_per_key(found.join(ids, "c_custkey", "left_semi"), ["c_custkey"], F.col("o_orderkey"))


@query("f01_keyword_and", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'eco')")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(matches_query("Ring AND ECO", F.col("p_name"), F.col("p_brand"), F.col("p_type"))).select("p_partkey")


@query("f01_keyword_or", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand)), 'bolt') OR contains(lower(concat_ws(' ', p_name, p_brand)), 'brand#3')")
def f01_or(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(matches_query("bolt OR Brand#3", F.col("p_name"), F.col("p_brand"))).select("p_partkey")


@query("f02_facets", f"WITH {CASES} SELECT case_id FROM cases WHERE year = 1996 AND contains(city, '1') AND outcome = 'supported' AND amount >= 100000")
def f02(spark: SparkSession, d: str) -> DataFrame:
    """Facets that are set; ``None`` means no filter."""
    return filters.facets(cases(spark, d), equal={"year": 1996, "outcome": "supported", "level": None}, contains={"city": "1"}, least={"amount": 100000}).select("case_id")


@query("f03_library_filter", f"WITH {CASES}, {ITEMS} SELECT case_id FROM cases WHERE year = 1997 AND level IN ('1-URGENT', '2-HIGH') AND case_id IN (SELECT case_id FROM items WHERE kind = 'ECONOMY') AND contains(lower(segment), 'build')")
def f03(spark: SparkSession, d: str) -> DataFrame:
    tagged = case_items(spark, d).groupBy("case_id").agg(F.collect_set("kind").alias("kinds"))
    rows = cases(spark, d).join(tagged, "case_id").where(F.array_contains("kinds", "ECONOMY"))
    return filters.facets(rows, equal={"year": 1997}, among={"level": ["1-URGENT", "2-HIGH"]}).where(matches_query("build", F.col("segment"))).select("case_id")


@query("f04_level_canonical", "SELECT CASE WHEN regexp_matches(o_orderpriority, 'URGENT|HIGH') THEN 'first' WHEN regexp_matches(o_orderpriority, 'MEDIUM') THEN 'second' WHEN regexp_matches(o_orderpriority, 'LOW') THEN 'retrial' ELSE 'unknown' END AS level, count(*) AS n FROM orders GROUP BY 1")
def f04(spark: SparkSession, d: str) -> DataFrame:
    level = filters.canonical(F.col("o_orderpriority"), {"first": "URGENT|HIGH", "second": "MEDIUM", "retrial": "LOW"})
    return table(spark, d, "orders").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("f05_region_predicate", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR n_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 2))")
def f05(spark: SparkSession, d: str) -> DataFrame:
    """Rules of a region or of single places, joined by or; the rules resolve to places first."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    chosen = nation.where((F.col("r_name") == "ASIA") | F.col("n_nationkey").isin(1, 2)).select("n_nationkey")
    return table(spark, d, "customer").join(chosen, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("f07_date_range", "SELECT count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1997-07-01'")
def f07(spark: SparkSession, d: str) -> DataFrame:
    """By whole dates, not by year alone."""
    return filters.between_days(table(spark, d, "orders"), "o_orderdate", "1996-02-01", "1997-06-30").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("f08_exclusion", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (1, 2, 3, 4, 5)")
def f08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(~F.col("o_custkey").isin(1, 2, 3, 4, 5)).agg(F.count("*").alias("n"))


_GATE = """g AS (SELECT case_id, outcome, amount, list_filter([CASE WHEN level = '4-NOT SPECIFIED' THEN 'review_pending' END, CASE WHEN outcome = 'unclear' THEN 'critical_outcome_unclear' END, CASE WHEN amount > 450000 THEN 'audit_failed' END], lambda x: x IS NOT NULL) AS reasons FROM cases)"""


@query("f09_admission_gate", f"WITH {CASES}, {_GATE} SELECT CASE WHEN len(reasons) = 0 THEN 'eligible' ELSE 'blocked' END AS status, array_to_string(reasons, ',') AS reasons, count(*) AS n FROM g GROUP BY 1, 2")
def f09(spark: SparkSession, d: str) -> DataFrame:
    reasons = {"review_pending": F.col("level") == "4-NOT SPECIFIED", "critical_outcome_unclear": F.col("outcome") == "unclear", "audit_failed": F.col("amount") > 450000}
    gated = filters.gate(cases(spark, d), reasons)
    return gated.groupBy("status", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("f10_accepted_source", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'human_review' WHEN o_orderkey % 3 = 0 THEN 'model' ELSE 'rule' END AS source, CASE WHEN o_orderkey % 7 = 0 THEN 'H' WHEN o_orderkey % 3 = 0 THEN 'M' ELSE o_orderstatus END AS value FROM orders")
def f10(spark: SparkSession, d: str) -> DataFrame:
    """A value from the first source that has one: review, model, rule."""
    orders = table(spark, d, "orders")
    human = orders.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("H").alias("value"))
    model = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("M").alias("value"))
    rule = orders.select("o_orderkey", F.col("o_orderstatus").alias("value"))
    return filters.first_source(orders.select("o_orderkey"), "o_orderkey", {"human_review": human, "model": model, "rule": rule})


@query("f16_amount_conflict", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_extendedprice * (1 - l_discount) > 0 AND l_extendedprice > l_extendedprice * (1 - l_discount) AND l_quantity = 50")
def f16(spark: SparkSession, d: str) -> DataFrame:
    awarded = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").where((F.col("l_returnflag") == "A") & filters.amount_conflict(F.col("l_extendedprice"), awarded) & (F.col("l_quantity") == 50)).select("l_orderkey", "l_linenumber")


@query("o02_page", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def o02(spark: SparkSession, d: str) -> DataFrame:
    return filters.page(table(spark, d, "customer").select("c_custkey", "c_acctbal"), 3, 20, F.desc("c_acctbal"), "c_custkey")


@query("o02_page_clamped", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 20")
def o02_last(spark: SparkSession, d: str) -> DataFrame:
    """A page beyond the end is the last one."""
    return filters.page(table(spark, d, "nation").select("n_nationkey"), 99, 10, "n_nationkey")


@query("o03_key_members_first", "SELECT p_type, count(*) AS n, p_type IN ('SMALL', 'LARGE') AS is_key FROM part GROUP BY p_type ORDER BY is_key DESC, n DESC, p_type LIMIT 4")
def o03(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).withColumn("is_key", F.col("p_type").isin("SMALL", "LARGE"))
    return counts.orderBy(F.desc("is_key"), F.desc("n"), "p_type").limit(4)


@query("e01_union_of_keys", "SELECT p_type AS key FROM part UNION SELECT unnest(['SMALL', 'OTHER'])")
def e01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_type").alias("key")).unionByName(spark.createDataFrame([("SMALL",), ("OTHER",)], "key string")).distinct()


@query("e02_common_items", f"WITH {ITEMS} SELECT kind FROM items WHERE case_id = 1 INTERSECT SELECT kind FROM items WHERE case_id = 2")
def e02(spark: SparkSession, d: str) -> DataFrame:
    items = case_items(spark, d)
    return items.where("case_id = 1").select("kind").intersect(items.where("case_id = 2").select("kind"))


@query("e03_remaining", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def e03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey").distinct())


@query("e04_subset_test", "SELECT count(*) AS outside FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey")
def e04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("outside"))


@query("e05_duplicate_test", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def e05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1")


@query("e06_merge_last_wins", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def e06(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return keyed.merge_last(old, old.where("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("CHANGED")), "c_custkey")
