"""The training-data operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import decontamination, html_text, language_id, line_dedup, ngram_jaccard, packing, prefix_trie, quality, secret_scan, spelling, substring_dedup, token_counts, toxicity
from verdigris.llm.common import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=5, percent=80)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar_groups(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, width=4096)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated(_table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"), materialise=materialise)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dicts = language_id.learn(docs.where(~language_id.held_out()))
    out = language_id.identify(docs, dicts)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.learn(docs, labels.where(~toxicity.held_out())))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.grafted(_table(spark, sf_dir, "conversations"))
    return prefix_trie.nodes(turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.words(_table(spark, sf_dir, "documents"), typo_rate=97, min_length=5, min_count=3)
    return spelling.variants(words, factor=2)


OP2_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') FROM benchmark),
items AS (
  SELECT id AS item_id, width, unnest(list_distinct(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i : i + width - 1], ' ')))) AS s
  FROM (SELECT *, least(5, len(w)) AS width FROM words WHERE kind = 'i' AND len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
widths AS (SELECT DISTINCT width FROM items),
docs AS (
  SELECT id AS doc_id, width, unnest(list_distinct(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i : i + width - 1], ' ')))) AS s
  FROM words, widths WHERE kind = 'd' AND len(w) >= width),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (width, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""

OP4_SQL = r"""
WITH lines AS (
  SELECT rowid AS r, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
keyed AS (
  SELECT r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
ids AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
frequent AS (
  SELECT k FROM keyed JOIN ids USING (r) WHERE k <> '' GROUP BY k
  HAVING count(DISTINCT (doc_id, coalesce(text, ''))) >= 10),
marked AS (SELECT r, pos, line, k IN (SELECT k FROM frequent) AS dropped FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked JOIN ids USING (r) GROUP BY r, doc_id
"""

OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(y) FROM reach WHERE x = doc_id) AS component_id FROM sets
"""

OP7_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM later, range(20) AS t(d)),
each AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

#: A table of one row for the crc32 of ISO 8859-1 texts, and the expression that uses it.
_CRC_TABLE = r"""crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t)"""
_CRC = r"""xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({text}, ''), lambda c:
    CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + ord(c)::BIGINT // 64, 128 + ord(c)::BIGINT % 64] END))),
    lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])))"""

OP12_SQL = (
    "WITH "
    + _CRC_TABLE
    + r""",
turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, """
    + _CRC.format(text="conv_id::VARCHAR")
    + r""" % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.i, t.r, t.x FROM ids c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.r, t.x FROM ids c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
paths AS (
  SELECT conv_id, string_agg(md5(len(r) || ':' || r || x), '') OVER w AS path, row_number() OVER w AS d, length(x) AS size
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)
  UNION ALL SELECT conv_id, '', 0, 0 FROM ids),
marked AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM paths),
nodes AS (
  SELECT path, any_value(d) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM marked GROUP BY path),
children AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)),
subtrees AS (
  SELECT left(path, 32 * k) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM known) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM known n JOIN subtrees s USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth - 1))
"""
)

OP13_SQL = (
    "WITH RECURSIVE "
    + _CRC_TABLE
    + r""",
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, """
    + _CRC.format(text="coalesce(doc_id::VARCHAR, '') || ':' || run")
    + r""" AS h FROM runs, crc_table),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (
  SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
reach(word, root) AS (
  SELECT word, coalesce(form, word) FROM forms UNION SELECT r.word, f.form FROM reach r JOIN forms f ON r.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN reach r USING (word) JOIN forms z ON r.root = z.word AND z.form IS NULL
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_secret_scan": op3_secret_scan,
        "op4_line_dedup": op4_line_dedup,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_packing": op6_packing,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_token_counts": op8_token_counts,
        "op9_quality_rules": op9_quality_rules,
        "op10_language_id": op10_language_id,
        "op11_toxicity": op11_toxicity,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": OP2_SQL, "op4_line_dedup": OP4_SQL, "op5_ngram_jaccard": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op12_prefix_trie": OP12_SQL, "op13_spelling_variants": OP13_SQL}
