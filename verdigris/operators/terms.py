"""Term statistics of a corpus: frequencies, TF-IDF, keyword counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import terms


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, n, length: how often each document has each term, and how many terms it has."""
    words = docs.select(id_col, terms(F.col(text_col)).alias("_w")).select(id_col, F.size("_w").alias("length"), F.explode("_w").alias("term"))
    return words.groupBy(id_col, "length", "term").agg(F.count("*").alias("n"))


def tf_idf(docs: DataFrame, id_col: str, text_col: str, least_docs: int = 2) -> DataFrame:
    """term, df, total, score: the mean over all documents of tf * idf, idf = ln((N + 1) / (df + 1)) + 1.

    The words of a row are sorted and counted there, so that a term leaves it once:
    one shuffle, by term, of sums that each task has made before.
    """
    n = docs.count()
    words = docs.select(F.array_sort(terms(F.col(text_col))).alias("_w")).where(F.size("_w") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: (i == 0) | (F.get("_w", i - 1) != F.get("_w", i)))
    words = words.select("_w", starts.alias("_s"))
    counted = F.transform("_s", lambda i, k: F.struct(F.get("_w", i).alias("term"), (F.coalesce(F.get("_s", k + 1), F.size("_w")) - i).alias("n")))
    rows = words.select(F.size("_w").alias("_length"), F.explode(counted).alias("x"))
    by_term = rows.groupBy("x.term").agg(F.count("*").alias("df"), F.sum("x.n").alias("total"), F.sum(F.col("x.n") / F.col("_length")).alias("_tf"))
    idf = F.ln((F.lit(n) + 1) / (F.col("df") + 1)) + 1
    return by_term.where(F.col("df") >= least_docs).select("term", "df", "total", F.round(F.col("_tf") * idf / n, 4).alias("score"))


def keyword_documents(docs: DataFrame, text_col: str, keywords: list[str]) -> DataFrame:
    """keyword, n: documents that contain it; all keywords in one pass, without exploding."""
    one = docs.agg(*(F.count_if(F.contains(F.lower(F.col(text_col)), F.lit(k))).alias(f"k{i}") for i, k in enumerate(keywords)))
    rows = F.array(*(F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("n")) for i, k in enumerate(keywords)))
    return one.select(F.explode(rows).alias("r")).select("r.*")
