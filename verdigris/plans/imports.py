"""Queries of readers, writers and row-level changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import keyed
from verdigris.plans.registry import query
from verdigris.sources import exports, imports
from verdigris.sources.tables import CASES, ITEMS, case_items, cases, table


@query("s06_paged_search", "SELECT c_custkey // 50 AS page, c_custkey AS id, c_name AS name, (SELECT count(*) FROM customer) AS total FROM customer WHERE c_custkey // 50 % 7 <> 3")
def s06(spark: SparkSession, d: str) -> DataFrame:
    """Rows of recorded pages under different names; pages that failed are left to s08."""
    return imports.page_rows(_bodies(spark, d), "id long, name string").where("error IS NULL").select("page", "row.id", "row.name", "total")


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """Responses as a search gives them: 50 rows each, with changing names; every seventh is cut off."""
    rows = table(spark, d, "customer")
    total = rows.count()
    page = F.floor(F.col("c_custkey") / 50).alias("page")
    pages = rows.select(page, F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("r")).groupBy("page").agg(F.to_json(F.collect_list("r")).alias("rows"))  # 50 rows at most
    name = F.get(F.array(*map(F.lit, imports.ROWS)), (F.col("page") % 4).cast("int"))
    body = F.concat(F.lit('{"'), name, F.lit('":'), F.col("rows"), F.lit(f',"total":{total}}}'))
    return pages.select("page", F.when(F.col("page") % 7 == 3, F.substring(body, 1, 20)).otherwise(body).alias("body"))


@query("s07_detail_text", "SELECT conv_id, turn, sha256(coalesce(nullif(trim(CASE WHEN turn % 3 = 0 THEN text END), ''), CASE WHEN role = 'user' AND trim(coalesce(text, '')) <> '' THEN '【parties】' || chr(10) || trim(text) END, nullif(trim(text), ''), '')) AS text_sha256 FROM conversations")
def s07(spark: SparkSession, d: str) -> DataFrame:
    """The best text that a detail page has."""
    text = F.col("text")
    full = imports.detail_text(F.when(F.col("turn") % 3 == 0, text), {"parties": F.when(F.col("role") == "user", text)}, text)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(full, 256).alias("text_sha256"))


@query("s08_page_failures", "SELECT c_custkey // 50 % 7 = 3 AS failed, count(DISTINCT c_custkey // 50) AS pages FROM customer GROUP BY 1")
def s08(spark: SparkSession, d: str) -> DataFrame:
    """Failed pages are rows with an error, counted beside the good ones."""
    rows = imports.page_rows(_bodies(spark, d), "id long, name string").select("page", F.col("error").isNotNull().alias("failed")).distinct()
    return rows.groupBy("failed").agg(F.count("*").alias("pages"))


_A = """'(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>'"""


@query(
    "s09_directory_links",
    f"""WITH l AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, {_A}, 1)) AS href, trim(regexp_replace(unnest(regexp_extract_all(html, {_A}, 2)), '<[^>]+>', '', 'g')) AS title FROM pages)
    SELECT page_id, title, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(base, '^(https?://[^/]+)', 1) || href ELSE regexp_extract(base, '^(https?://[^?#]*/)', 1) || href END AS url FROM l WHERE length(title) >= 6 AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:')""",
)
def s09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(imports.links(F.col("html"), F.col("url"))).alias("l")).select("page_id", "l.title", "l.url")


_INDEX = [f"https://example.org/list/{k}" for k in range(1, 6)]


@query("s10_index_pages", "SELECT unnest(range(1, 6))::INTEGER AS position, 'https://example.org/list/' || unnest(range(1, 6)) AS url")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """A fixed list of pages."""
    return spark.createDataFrame(list(enumerate(_INDEX, 1)), "position int, url string")


@query("s11_fetch_errors", "SELECT CASE WHEN s IS NULL THEN 'network' WHEN s = 404 THEN 'not_found' WHEN s IN (401, 403) THEN 'forbidden' WHEN s = 429 THEN 'rate_limited' WHEN s >= 500 THEN 'server' WHEN s >= 400 THEN 'client' WHEN trim(coalesce(props, '')) = '' THEN 'empty' END AS error, count(*) AS n FROM (SELECT [200, 404, 403, 429, 503, 418, NULL, 200][1 + event_id % 8] AS s, props FROM events) GROUP BY 1")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """Fetches by kind of failure."""
    status = F.get(F.array(*map(F.lit, [200, 404, 403, 429, 503, 418, None, 200])), (F.col("event_id") % 8).cast("int"))
    return table(spark, d, "events").groupBy(imports.fetch_error(status, F.col("props")).alias("error")).agg(F.count("*").alias("n"))


_HASH = r"sha256(trim(regexp_replace({x}, '[ \t-\r]+', ' ', 'g')))"


@query("s12_text_import", f"WITH k AS (SELECT {_HASH.format(x='text')} AS h, min(doc_id) AS duplicate_of FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), n AS (SELECT doc_id, trim(text, ' ' || chr(10) || chr(13) || chr(9)) AS t FROM documents WHERE doc_id % 2 = 1) SELECT doc_id, {_HASH.format(x='t')} AS content_hash, duplicate_of FROM n LEFT JOIN k ON h = {_HASH.format(x='t')} WHERE t <> ''")
def s12(spark: SparkSession, d: str) -> DataFrame:
    """Texts to import against those stored."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return imports.import_texts(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")).drop("text")


@query("s13_html_import")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """Text of each page's main container."""
    return table(spark, d, "pages").select("page_id", F.sha2(imports.import_html(F.col("html")), 256).alias("text_sha256"))


@query("s14_web_archives", "SELECT page_id, sha256(html) AS html_sha256 FROM pages WHERE html <> ''")
def s14(spark: SparkSession, d: str) -> DataFrame:
    """Pages wrapped as web archives and read back: the largest HTML part, decoded."""
    line = "\r\n"
    head = f'MIME-Version: 1.0{line}Content-Type: multipart/related; boundary="b0"{line}{line}--b0{line}Content-Type: text/html; charset="utf-8"{line}Content-Transfer-Encoding: base64{line}{line}'
    small = f"{line}--b0{line}Content-Type: text/html{line}{line}<p>a</p>{line}--b0--{line}"
    rows = table(spark, d, "pages").where("html <> ''").select("page_id", F.concat(F.lit(head), F.base64(F.col("html").cast("binary")), F.lit(small)).cast("binary").alias("content"))
    return imports.read_archives(rows).select("page_id", F.sha2("html", 256).alias("html_sha256"))


@query("s16_backup_restore", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as JSON and read again; those that lack a required field are left out."""
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).alias("c_name"), "c_mktsegment")
    return imports.restore(exports.json_lines(rows), "c_custkey long, c_name string, c_mktsegment string", ["c_custkey", "c_name"])


@query("k01_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 0.0")
def k01(spark: SparkSession, d: str) -> DataFrame:
    """Rows put by key: new ones are added, known ones replaced."""
    old = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = old.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(spark.createDataFrame([(-1, 0.0)], "c_custkey long, c_acctbal double"))
    return keyed.merge_last(old, new, "c_custkey")


@query("k04_replace_details", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 4 <> 0 OR l_linenumber = 1 GROUP BY l_orderkey")
def k04(spark: SparkSession, d: str) -> DataFrame:
    """All detail rows of some headers replaced by new ones."""
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    headers = old.select("l_orderkey").where("l_orderkey % 4 = 0").distinct()
    return keyed.replace_details(old, old.where("l_orderkey % 4 = 0 AND l_linenumber = 1"), headers, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("k05_insert_tasks", "WITH i AS (SELECT DISTINCT url FROM pages), s AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 = 0) SELECT url IN (SELECT url FROM s) AS existing, count(*) AS n FROM i GROUP BY 1")
def k05(spark: SparkSession, d: str) -> DataFrame:
    """Found addresses, new and known."""
    pages = table(spark, d, "pages").select("url")
    known = table(spark, d, "pages").where("page_id % 3 = 0").select("url", F.lit(True).alias("known")).distinct()
    return pages.distinct().join(known, "url", "left").groupBy(F.col("known").isNotNull().alias("existing")).agg(F.count("*").alias("n"))


@query("k06_delete", "SELECT count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def k06(spark: SparkSession, d: str) -> DataFrame:
    """What is left after the rows of some keys are deleted."""
    gone = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return keyed.delete(table(spark, d, "orders"), gone, "o_custkey").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


@query("k07_guarded_delete", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS refused FROM customer WHERE c_custkey % 2 = 0")
def k07(spark: SparkSession, d: str) -> DataFrame:
    """Deletions asked for, refused where another table refers to the row."""
    return keyed.deletions(table(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def _csv_sql(*fields: str) -> str:
    return " || ',' || ".join(f"""'"' || coalesce(replace(replace(({f})::VARCHAR, '"', '""'), chr(10), ' '), '') || '"'""" for f in fields)


@query("k08_csv_cases", f"WITH {CASES}, {ITEMS}, t AS (SELECT case_id, string_agg(DISTINCT kind, '; ' ORDER BY kind) AS kinds FROM items GROUP BY case_id) SELECT case_id, {_csv_sql('case_id', 'city', 'year', 'kinds', 'outcome', 'substring(segment, 1, 5)')} AS line FROM cases LEFT JOIN t USING (case_id)")
def k08(spark: SparkSession, d: str) -> DataFrame:
    """Cases as CSV lines: quotes doubled, lists joined, long texts clipped."""
    tags = case_items(spark, d).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), "; ").alias("kinds"))
    c = F.col
    return exports.csv_lines(cases(spark, d).join(tags, "case_id", "left"), {"ID": c("case_id"), "city": c("city"), "year": c("year"), "types": c("kinds"), "outcome": c("outcome"), "segment": F.substring("segment", 1, 5)}, "case_id")


@query("k09_csv_tasks", f"SELECT page_id, {_csv_sql('page_id', 'url', 'length(html)')} AS line FROM pages")
def k09(spark: SparkSession, d: str) -> DataFrame:
    return exports.csv_lines(table(spark, d, "pages"), {"ID": F.col("page_id"), "url": F.col("url"), "size": F.length("html")}, "page_id")


@query("k10_json_backup", """SELECT 'nation' AS name, n_nationkey AS k, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation UNION ALL SELECT 'region', r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' FROM region""")
def k10(spark: SparkSession, d: str) -> DataFrame:
    """A backup of tables as JSON lines."""
    out = None
    for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey")):
        rows = exports.json_lines(table(spark, d, name), key).select(F.lit(name).alias("name"), F.col(key).alias("k"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("k13_batch_reparse", "SELECT event_type, count(*) AS total, count(k) AS succeeded, count(*) - count(k) AS failed FROM (SELECT event_type, CASE WHEN event_id % 9 <> 0 THEN (props->>'k')::INTEGER END AS k FROM events) GROUP BY event_type")
def k13(spark: SparkSession, d: str) -> DataFrame:
    """Rows parsed anew; one that fails keeps its error and harms no other."""
    body = F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    value = F.from_json(body, "k int, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = table(spark, d, "events").select("event_type", value.alias("v"))
    return rows.groupBy("event_type").agg(F.count("*").alias("total"), F.count("v.k").alias("succeeded"), F.count_if(F.col("v.k").isNull()).alias("failed"))
