"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import decontamination, language_id, line_dedup, ngram_jaccard, packing
from verdigris.llm.common import discard, materialise, small_batches, written
from verdigris.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the dictionaries come from a bounded sample of the labelled ones."""
    small_batches(spark)
    return language_id.known_language(docs, language_id.learn(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more distinct texts have; which copy stays is for the next stage."""
    small_batches(spark)
    return line_dedup.without_frequent_lines(docs, length_col="n_chars", min_docs=10, by_text=True, keep_empty=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    small_batches(spark)
    return ngram_jaccard.one_of_each_group(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, width=4096)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("packing", pack),
]
#: The first stage compresses texts, which SQL can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table takes the place of all that it was made from."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        discard(spark, mark, keep=1)
    return docs
