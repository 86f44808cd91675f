"""Join queries: outer, semi, anti, ordered, fallback, substring, grids, combinations, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.rates import outcome_counts, percent
from verdigris.operators import keyed, matching
from verdigris.plans.registry import query
from verdigris.sources.tables import CASES, ITEMS, case_items, cases, table

KEYS = ["ECONOMY", "SMALL", "PROMO", "SMALL BRASS", "MED", ""]


@query("j01_left_outer_review", "SELECT d.doc_id, quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def j01(spark: SparkSession, d: str) -> DataFrame:
    """Records with their review where there is one, defaults filled in."""
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("j02_ordered_inner", "SELECT pos::INTEGER AS pos, c_custkey, c_name FROM (SELECT unnest([5, 3, 99999999, 8, 5]) AS id, unnest([0, 1, 2, 3, 4]) AS pos) JOIN customer ON id = c_custkey")
def j02(spark: SparkSession, d: str) -> DataFrame:
    """Records of a list of ids, with each id's place in the list."""
    ids = spark.createDataFrame([([5, 3, 99999999, 8, 5],)], "ids array<long>").select(F.posexplode("ids").alias("pos", "c_custkey"))
    return table(spark, d, "customer").join(ids, "c_custkey").select("pos", "c_custkey", "c_name")


@query("j03_missing", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def j03(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an open order."""
    open_ = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(open_, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j04_stored_and_new", "SELECT o_custkey IS NOT NULL AS stored, count(*) AS n FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey GROUP BY 1")
def j04(spark: SparkSession, d: str) -> DataFrame:
    """Candidates already stored against those to be fetched."""
    stored = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey").distinct()
    both = table(spark, d, "customer").join(stored, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.groupBy(F.col("o_custkey").isNotNull().alias("stored")).agg(F.count("*").alias("n"))


@query(
    "j05_fallback_key",
    """WITH u AS (SELECT c_name AS name, min(c_custkey) AS id FROM customer GROUP BY c_name HAVING count(*) = 1), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey, coalesce(c_custkey, u.id) AS c_custkey, CASE WHEN c_custkey IS NOT NULL THEN 1 WHEN u.id IS NOT NULL THEN 2 END::INTEGER AS rule FROM a LEFT JOIN customer ON a.id = c_custkey LEFT JOIN u ON a.name = u.name""",
)
def j05(spark: SparkSession, d: str) -> DataFrame:
    """By id, else by a name that only one has."""
    customer = table(spark, d, "customer").select("c_custkey", "c_name")
    unique = customer.groupBy("c_name").agg(F.min("c_custkey").alias("c_custkey"), F.count("*").alias("n")).where("n = 1").select("c_custkey", "c_name")
    names = customer.select("c_custkey", F.col("c_custkey").alias("by_id"), F.lit(None).cast("string").alias("by_name")).unionByName(unique.select("c_custkey", F.lit(None).cast("long").alias("by_id"), F.col("c_name").alias("by_name")))
    orders = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("id"), F.col("c_name").alias("name"))
    return matching.priority_lookup(orders, "o_orderkey", names, "c_custkey", [("id", "by_id"), ("name", "by_name")]).select("o_orderkey", "c_custkey", "rule")


@query("j06_orphans", "SELECT doc_id FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') USING (doc_id)")
def j06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query(
    "j07_substring_match",
    f"""WITH {CASES}, {ITEMS}, k AS (SELECT unnest(['ECONOMY', 'SMALL', 'PROMO', 'SMALL BRASS', 'MED', '']) AS key), t AS (SELECT DISTINCT case_id, kind FROM items), m AS (SELECT case_id, key FROM t JOIN k ON contains(kind, key) OR contains(key, kind)),
    s AS (SELECT key, count(*) AS frequency, count(DISTINCT case_id) AS cases FROM m GROUP BY key) SELECT * FROM s""",
)
def j07(spark: SparkSession, d: str) -> DataFrame:
    facts = case_items(spark, d).select("case_id", "kind").distinct()
    return matching.match_keys(facts, "kind", KEYS).groupBy("key").agg(F.count("*").alias("frequency"), F.count_distinct("case_id").alias("cases"))


@query(
    "j08_dense_grid",
    f"WITH {CASES}, r AS (SELECT unnest(['BUILDING', 'MACHINERY', 'NOWHERE']) AS segment), c AS (SELECT unnest(['1-URGENT', '5-LOW', '9-NONE']) AS level), n AS (SELECT segment, level, count(*) AS n FROM cases GROUP BY segment, level) SELECT segment, level, coalesce(n, 0) AS n FROM r CROSS JOIN c LEFT JOIN n USING (segment, level)",
)
def j08(spark: SparkSession, d: str) -> DataFrame:
    return matching.grid(["BUILDING", "MACHINERY", "NOWHERE"], ["1-URGENT", "5-LOW", "9-NONE"], cases(spark, d), "segment", "level")


@query(
    "a11_outcome_matrix",
    f"""WITH {CASES}, s AS (SELECT segment, level, count(*) FILTER (WHERE outcome = 'supported') AS supported, count(*) FILTER (WHERE outcome = 'partially_supported') AS partially_supported, count(*) FILTER (WHERE outcome = 'not_supported') AS not_supported, count(*) FILTER (WHERE outcome = 'unclear') AS unclear, count(*) FILTER (WHERE outcome <> 'unclear') AS known FROM cases GROUP BY segment, level)
    SELECT *, CASE WHEN known > 0 THEN round(not_supported::DOUBLE / known * 100, 1) ELSE 0 END AS held_rate FROM s""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    cells = cases(spark, d).groupBy("segment", "level").agg(*outcome_counts(F.col("outcome")))
    return cells.withColumn("held_rate", percent(F.col("not_supported"), F.col("known"), none=0.0))


@query(
    "j09_pairs",
    f"WITH {ITEMS}, k AS (SELECT DISTINCT case_id, kind FROM items) SELECT x.kind AS a, y.kind AS b, count(*) AS n FROM k x JOIN k y ON x.case_id = y.case_id AND x.kind < y.kind GROUP BY 1, 2",
)
def j09(spark: SparkSession, d: str) -> DataFrame:
    return matching.combinations(case_items(spark, d), "case_id", "kind", 2).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    "j10_triples",
    f"WITH {ITEMS}, k AS (SELECT DISTINCT case_id, kind FROM items) SELECT x.kind AS a, y.kind AS b, z.kind AS c, count(*) AS n FROM k x JOIN k y ON x.case_id = y.case_id AND x.kind < y.kind JOIN k z ON z.case_id = x.case_id AND y.kind < z.kind GROUP BY 1, 2, 3",
)
def j10(spark: SparkSession, d: str) -> DataFrame:
    return matching.combinations(case_items(spark, d), "case_id", "kind", 3).groupBy("a", "b", "c").agg(F.count("*").alias("n"))


@query(
    "a10_combination_support",
    f"""WITH {CASES}, {ITEMS}, k AS (SELECT DISTINCT case_id, kind FROM items), p AS (SELECT x.case_id, x.kind AS a, y.kind AS b FROM k x JOIN k y ON x.case_id = y.case_id AND x.kind < y.kind),
    s AS (SELECT a, b, count(*) AS cases, count(*) FILTER (WHERE outcome = 'supported') AS supported FROM p JOIN cases USING (case_id) GROUP BY a, b) SELECT *, round(supported::DOUBLE / cases * 100, 1) AS support_rate FROM s ORDER BY supported DESC, a, b LIMIT 5""",
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    pairs = matching.combinations(case_items(spark, d), "case_id", "kind", 2).join(cases(spark, d).select("case_id", "outcome"), "case_id")
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("cases"), F.count_if(F.col("outcome") == "supported").alias("supported"))
    return out.withColumn("support_rate", percent(F.col("supported"), F.col("cases"), none=0.0)).orderBy(F.desc("supported"), "a", "b").limit(5)


@query(
    "a10_combinations_of_all_sizes",
    f"""WITH {CASES}, {ITEMS}, k AS (SELECT DISTINCT case_id, kind FROM items), c AS (SELECT case_id, 1 AS size, kind AS combo FROM k UNION ALL SELECT x.case_id, 2, x.kind || ' + ' || y.kind FROM k x JOIN k y ON x.case_id = y.case_id AND x.kind < y.kind
    UNION ALL SELECT x.case_id, 3, x.kind || ' + ' || y.kind || ' + ' || z.kind FROM k x JOIN k y ON x.case_id = y.case_id AND x.kind < y.kind JOIN k z ON z.case_id = x.case_id AND y.kind < z.kind),
    s AS (SELECT size, combo, count(*) AS cases, count(*) FILTER (WHERE outcome = 'supported') AS supported, count(*) FILTER (WHERE outcome <> 'unclear') AS known FROM c JOIN cases USING (case_id) GROUP BY size, combo)
    SELECT *, CASE WHEN known > 0 THEN round(supported::DOUBLE / known * 100, 1) END AS rate FROM s""",
)
def a10_all(spark: SparkSession, d: str) -> DataFrame:
    """Single kinds, pairs and triples of a case's kinds, made from its own sorted list in one pass."""
    own = case_items(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_set("kind")).alias("x"))
    joined = lambda *p: F.concat_ws(" + ", *p)
    after = lambda i: F.slice("x", i + 2, F.greatest(F.size("x") - i - 1, F.lit(0)))
    one = F.transform("x", lambda a: F.struct(F.lit(1).alias("size"), a.alias("combo")))
    two = F.flatten(F.transform("x", lambda a, i: F.transform(after(i), lambda b: F.struct(F.lit(2).alias("size"), joined(a, b).alias("combo")))))
    three = F.flatten(F.transform("x", lambda a, i: F.flatten(F.transform(after(i), lambda b, j: F.transform(after(i + j + 1), lambda c: F.struct(F.lit(3).alias("size"), joined(a, b, c).alias("combo")))))))
    rows = own.select("case_id", F.explode(F.concat(one, two, three)).alias("c")).join(cases(spark, d).select("case_id", "outcome"), "case_id")
    out = rows.groupBy("c.size", "c.combo").agg(F.count("*").alias("cases"), F.count_if(F.col("outcome") == "supported").alias("supported"), F.count_if(F.col("outcome") != "unclear").alias("known"))
    return out.withColumn("rate", percent(F.col("supported"), F.col("known")))


@query(
    "j11_within_row_product",
    f"WITH {ITEMS}, k AS (SELECT DISTINCT case_id, kind FROM items), b AS (SELECT DISTINCT case_id, brand FROM items) SELECT kind, brand, count(*) AS n FROM k JOIN b USING (case_id) GROUP BY kind, brand",
)
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Each kind of a case with each of its brands."""
    one = case_items(spark, d).groupBy("case_id").agg(F.collect_set("kind").alias("ks"), F.collect_set("brand").alias("bs"))
    return one.select(F.explode("ks").alias("kind"), "bs").select("kind", F.explode("bs").alias("brand")).groupBy("kind", "brand").agg(F.count("*").alias("n"))


@query(
    "a22_cooccurrence",
    f"""WITH {ITEMS}, k AS (SELECT DISTINCT case_id, brand FROM items), s AS (SELECT brand, count(*) AS n FROM k GROUP BY brand), p AS (SELECT x.brand AS a, y.brand AS b, count(*) AS n FROM k x JOIN k y ON x.case_id = y.case_id AND x.brand < y.brand GROUP BY 1, 2)
    SELECT a, b, p.n, sa.n AS n_a, sb.n AS n_b, round(p.n::DOUBLE / (sa.n + sb.n - p.n), 3) AS jaccard FROM p JOIN s sa ON sa.brand = a JOIN s sb ON sb.brand = b ORDER BY n DESC, jaccard DESC, a, b LIMIT 80""",
)
def a22(spark: SparkSession, d: str) -> DataFrame:
    return matching.cooccurrence(case_items(spark, d), "case_id", "brand").orderBy(F.desc("n"), F.desc("jaccard"), "a", "b").limit(80)


@query(
    "j12_similar_cases",
    r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents), t AS (SELECT doc_id, term, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2), norm AS (SELECT doc_id, sqrt(sum(n * n)) AS n FROM t GROUP BY doc_id), o AS (SELECT * FROM t WHERE doc_id % 50 = 0),
    c AS (SELECT o.doc_id AS query, t.doc_id AS id, round(sum(t.n * o.n) / (any_value(a.n) * any_value(b.n)), 6) AS cosine FROM t JOIN o USING (term) JOIN norm a ON a.doc_id = t.doc_id JOIN norm b ON b.doc_id = o.doc_id WHERE t.doc_id <> o.doc_id GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id)::INTEGER AS position FROM c) WHERE position <= 10""",
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    """The ten documents most like each query document; queries are those whose id is divisible by 50."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return matching.similar_documents(docs, docs.where("doc_id % 50 = 0"), 10, id_col="doc_id", text_col="text")


@query(
    "j13_priority_lookup",
    """WITH p AS (SELECT p_name, min(p_partkey) AS id FROM part WHERE p_size < 25 GROUP BY p_name), b AS (SELECT p_brand, min(p_partkey) AS id FROM part WHERE p_size < 25 GROUP BY p_brand)
    SELECT x.p_partkey, coalesce(p.id, b.id) AS found, CASE WHEN p.id IS NOT NULL THEN 1 WHEN b.id IS NOT NULL THEN 2 END::INTEGER AS rule FROM part x LEFT JOIN p USING (p_name) LEFT JOIN b USING (p_brand) WHERE x.p_size >= 25""",
)
def j13(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    known = part.where("p_size < 25").select(F.col("p_partkey").alias("found"), F.col("p_name").alias("k_name"), F.col("p_brand").alias("k_brand"))
    return matching.priority_lookup(part.where("p_size >= 25").select("p_partkey", "p_name", "p_brand"), "p_partkey", known, "found", [("p_name", "k_name"), ("p_brand", "k_brand")]).select("p_partkey", "found", "rule")


@query("j14_array_members", "SELECT c_custkey, count(o_orderkey) AS n FROM (SELECT c_custkey, unnest([c_custkey, c_custkey + 1, c_custkey + 2]) AS ref FROM customer) JOIN orders ON ref = o_custkey GROUP BY c_custkey")
def j14(spark: SparkSession, d: str) -> DataFrame:
    """References held in an array, exploded and joined by equality."""
    refs = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 1, F.col("c_custkey") + 2)).alias("ref"))
    return refs.join(table(spark, d, "orders"), F.col("ref") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("j16_drill_down", f"WITH {CASES} SELECT * FROM cases WHERE city = 'NATION_3' AND outcome = 'unclear'")
def j16(spark: SparkSession, d: str) -> DataFrame:
    """The records behind one figure."""
    return cases(spark, d).where((F.col("city") == "NATION_3") & (F.col("outcome") == "unclear"))


@query("j17_integrity", "SELECT 'orders.customer' AS link, (SELECT count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey) AS broken UNION ALL SELECT 'lineitem.orders', (SELECT count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey) UNION ALL SELECT 'labels.documents', (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id))")
def j17(spark: SparkSession, d: str) -> DataFrame:
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id")]
    out = None
    for child, key, parent, other in links:
        broken = table(spark, d, child).select(F.col(key).alias("k")).join(table(spark, d, parent).select(F.col(other).alias("k")), "k", "left_anti").agg(F.count("*").alias("broken"))
        one = broken.select(F.lit(f"{child}.{parent}").alias("link"), "broken")
        out = one if out is None else out.unionByName(one)
    return out


@query("k02_insert_new", "SELECT count(*) AS n, count(DISTINCT c_name) AS names FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0 AND c_name NOT IN (SELECT c_name FROM customer WHERE c_custkey % 2 = 0))")
def k02(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are new by id and by name."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    new = keyed.insert_new(rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 3 = 0"), ["c_custkey"], ["c_name"])
    return new.agg(F.count("*").alias("n"), F.count_distinct("c_name").alias("names"))


@query("k03_flag_duplicates", "SELECT doc_id, CASE WHEN min(doc_id) OVER (PARTITION BY sha256(text)) <> doc_id THEN min(doc_id) OVER (PARTITION BY sha256(text)) END AS duplicate_of FROM documents")
def k03(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return keyed.flag_duplicates(rows, "h", "doc_id").select("doc_id", "duplicate_of")


@query(
    "vector_similarity",
    """WITH c AS (SELECT q.vec_id AS query, r.vec_id AS id, round(list_cosine_similarity(r.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id)::INTEGER AS position FROM c) WHERE position <= 10""",
)
def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to each query vector; queries are those whose id is divisible by 50."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return matching.nearest(rows, rows.where("vec_id % 50 = 0"), 10, id_col="vec_id", vector_col="embedding")
