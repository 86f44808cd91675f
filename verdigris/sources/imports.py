"""Readers of recorded responses, pages, archives and backups."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.text import clean_html, content_hash

#: Where a response may hold its rows and its total.
ROWS, TOTALS = ("data", "items", "lawcases", "results"), ("total", "count", "totalCount")
MOST_PER_PAGE = 50


def page_size(requested: int) -> int:
    return min(max(requested, 1), MOST_PER_PAGE)


def recorded_pages(spark: SparkSession, path: str) -> DataFrame:
    """page (its file), body: recorded responses of a paged search, one file each, read in parallel."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page"), F.col("value").alias("body"))


def page_rows(bodies: DataFrame, row: str, *, keep: str = "page") -> DataFrame:
    """The rows of responses (page, body) under whichever name they are: page, total, row, error.

    A response that can't be read is one row with an error, so that one failed
    page doesn't end the job; an empty page has no row.
    """
    schema = ", ".join([*(f"{n} array<struct<{row}>>" for n in ROWS), *(f"{n} long" for n in TOTALS), "_corrupt string"])
    parsed = F.from_json("body", schema, {"columnNameOfCorruptRecord": "_corrupt"})
    out = bodies.select(keep, "body", parsed.alias("p"))
    found, total = F.coalesce(*(F.col("p")[n] for n in ROWS)), F.coalesce(*(F.col("p")[n] for n in TOTALS))
    error = F.when(F.col("body").isNull() | F.col("p._corrupt").isNotNull(), "malformed").when(found.isNull(), "no_rows")
    rows = F.when(error.isNull(), found).otherwise(F.array(F.lit(None)))
    return out.select(keep, total.alias("total"), error.alias("error"), F.explode(rows).alias("row"))


def detail_text(full: Column, sections: dict[str, Column], *others: Column) -> Column:
    """A document's text: the full one, else its sections under their headings, else what else there is, else empty."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    joined = F.concat_ws("\n\n", *(F.when(some(c).isNotNull(), F.concat(F.lit(f"【{name}】\n"), some(c))) for name, c in sections.items()))
    return F.coalesce(some(full), some(joined), *map(some, others), F.lit(""))


def links(html: Column, base: Column) -> Column:
    """An array of (title, url) of a directory page's links; titles of six characters or more, addresses made absolute."""
    pattern = F.lit("(?is)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>")
    both = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("title"))
    shaped = F.transform(both, lambda x: F.struct(F.trim(F.regexp_replace(x["title"], "<[^>]+>", "")).alias("title"), absolute(x["href"], base).alias("url"), x["href"].alias("href")))
    good = F.filter(shaped, lambda x: (F.length(x["title"]) >= 6) & ~F.startswith(x["href"], F.lit("#")) & ~F.startswith(x["href"], F.lit("javascript:")))
    return F.transform(good, lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url")))


def absolute(href: Column, base: Column) -> Column:
    site = F.regexp_extract(base, "^(https?://[^/]+)", 1)
    folder = F.regexp_extract(base, "^(https?://[^?#]*/)", 1)
    return F.when(href.rlike("^https?://"), href).when(F.startswith(href, F.lit("/")), F.concat(site, href)).otherwise(F.concat(folder, href))


def fetch_error(status: Column, body: Column) -> Column:
    """The kind of failure of a fetch; null for a good one."""
    return F.when(status.isNull(), "network").when(status == 404, "not_found").when(status.isin(401, 403), "forbidden").when(status == 429, "rate_limited").when(status >= 500, "server").when(status >= 400, "client").when(F.trim(F.coalesce(body, F.lit(""))) == "", "empty")


def import_texts(docs: DataFrame, stored: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (trimmed), content_hash, duplicate_of: the smallest stored id with the same content; empty texts go."""
    rows = docs.select(id_col, F.btrim(F.col(text_col), F.lit(" \n\r\t")).alias("text")).where("text <> ''").withColumn("content_hash", content_hash(F.col("text")))
    known = stored.select(F.col(id_col).alias("k"), content_hash(F.col(text_col)).alias("content_hash")).groupBy("content_hash").agg(F.min("k").alias("duplicate_of"))
    return rows.join(known, "content_hash", "left").select(id_col, "text", "content_hash", "duplicate_of")


def import_html(html: Column) -> Column:
    """Text of a page's main container, or of all of it without parts that are no content."""
    bare = F.regexp_replace(html, "(?is)<(script|style|nav|footer|header|aside|iframe)\\b[^>]*>.*?</\\1>", "")
    main = F.coalesce(*(F.nullif(F.regexp_extract(bare, f"(?is)<{tag}\\b[^>]*>(.*)</{tag}>", 1), F.lit("")) for tag in ("article", "main")), bare)
    return F.btrim(clean_html(main), F.lit(" \n\r\t"))


def archive_html(data: bytes | None) -> str | None:
    """The largest HTML part of a web archive, decoded from its transfer encoding and character set; null without one."""
    if not data:
        return None
    parts = []
    for part in email.message_from_bytes(data, policy=email.policy.default).walk():
        if part.get_content_type() == "text/html":
            raw = part.get_payload(decode=True) or b""
            for name in (part.get_content_charset(), "utf-8", "gb18030"):
                try:
                    parts.append(raw.decode(name or "utf-8"))
                    break
                except (LookupError, UnicodeDecodeError):
                    continue
    return max(parts, key=len, default=None)


def read_archives(rows: DataFrame, *, content_col: str = "content") -> DataFrame:
    """rows (as of ``binaryFile``) with html in place of the content."""
    keep = [c for c in rows.columns if c != content_col]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != content_col), "html string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in keep]
            html = pa.array([archive_html(x) for x in batch.column(content_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, html], names=[*keep, "html"])

    return rows.mapInArrow(run, schema)


def restore(lines: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Rows of a backup's JSON lines (value), without those that lack a required field."""
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    for c in required:
        rows = rows.where(F.col(c).isNotNull())
    return rows
