"""Text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text as tx
from verdigris.operators import terms
from verdigris.plans.registry import query
from verdigris.sources.tables import table

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_BLANKS = r"regexp_replace(translate(regexp_replace(regexp_replace(text, '[ \t' || chr(160) || chr(12288) || ']+', ' ', 'g'), '\r\n?', chr(10), 'g'), '“”‘’', '""' || chr(39) || chr(39)), '\n{3,}', chr(10) || chr(10), 'g')"


@query(
    "t01_clean_html",
    rf"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g') AS x FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</?({tx.BLOCK_TAGS})( [^>]*)?/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS x FROM a)
    SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')) AS text_sha256 FROM b""",
)
def t01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(tx.clean_html(F.col("html")), 256).alias("text_sha256"))


@query("t02_normalise_blanks", f"SELECT doc_id, sha256({_BLANKS}) AS text_sha256 FROM documents")
def t02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.normalise_blanks(F.col("text")), 256).alias("text_sha256"))


@query("t03_paragraphs", r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')) AS n FROM documents")
def t03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(tx.paragraphs(F.col("text"))).cast("long").alias("n"))


@query("t06_extract_all", """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS title FROM pages""")
def t06(spark: SparkSession, d: str) -> DataFrame:
    """All links of a page, address and title of one match side by side."""
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    links = F.arrays_zip(F.regexp_extract_all("html", pattern, 1).alias("url"), F.regexp_extract_all("html", pattern, 2).alias("title"))
    return table(spark, d, "pages").select("page_id", F.explode(links).alias("l")).select("page_id", "l.url", "l.title")


@query("t10_term_frequency", f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), e AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM w) SELECT doc_id, term, count(*) AS n, length FROM e GROUP BY doc_id, term, length")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_counts(table(spark, d, "documents"), "doc_id", "text").withColumn("length", F.col("length").cast("long"))


@query(
    "a21_tf_idf",
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), e AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM w), c AS (SELECT doc_id, term, count(*) AS n, length FROM e GROUP BY doc_id, term, length)
    SELECT term, count(*) AS df, sum(n)::BIGINT AS total, round(sum(n::DOUBLE / length) * (ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) + 1) / (SELECT count(*) FROM documents), 4) AS score FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY score DESC, total DESC, term LIMIT 30""",
)
def a21(spark: SparkSession, d: str) -> DataFrame:
    return terms.tf_idf(table(spark, d, "documents"), "doc_id", "text").orderBy(F.desc("score"), F.desc("total"), "term").limit(30)


@query("a15_keyword_documents", "SELECT k AS keyword, count(*) FILTER (WHERE contains(lower(text), k)) AS n FROM documents, (SELECT unnest(['the', 'password', 'licence', 'und', 'zzz']) AS k) GROUP BY k")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return terms.keyword_documents(table(spark, d, "documents"), "text", ["the", "password", "licence", "und", "zzz"])


@query("w08_char_ngrams", "WITH s AS (SELECT p_name, length(p_name) AS n FROM part) SELECT g, count(*) AS n FROM (SELECT unnest(CASE WHEN n <= 4 THEN [p_name] ELSE list_concat(list_transform(range(1, n), lambda i: substring(p_name, i, 2)), list_transform(range(1, n - 1), lambda i: substring(p_name, i, 3))) END) AS g FROM s) GROUP BY g")
def w08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.explode(tx.char_ngrams(F.col("p_name"))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


@query("w04_drop_repeated_lines", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, len(l) - len(list_filter(range(1, len(l) + 1), lambda i: NOT (i > 1 AND length(l[i]) > 5 AND l[i] = l[i - 1]))) AS dropped FROM l")
def w04(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", (F.size(lines) - F.size(tx.without_repeats(lines))).cast("long").alias("dropped"))


@query("m07_content_hash", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t-\r]+', ' ', 'g'))) AS h FROM documents")
def m07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("h"))


@query("p15_redact", r"""SELECT doc_id, length(regexp_replace(regexp_replace(text, '(?i)bearer +[a-z0-9._-]+', 'Bearer [redacted]', 'g'), '(?i)(api[_-]?key|token|secret|password)(["'']? *[:=] *["'']?)[a-z0-9._-]{6,}', '\1\2[redacted]', 'g')) AS n FROM documents""")
def p15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(tx.redact(F.col("text"), 1 << 30)).cast("long").alias("n"))


@query("n07_json", "SELECT (props->>'k')::INTEGER AS k, count(*) AS n FROM events GROUP BY 1")
def n07(spark: SparkSession, d: str) -> DataFrame:
    """JSON with a fixed schema; malformed text gives null."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))
