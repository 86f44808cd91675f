"""Incremental ingestion with checkpoints and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators.keyed import insert_new


def read_files(spark: SparkSession, path: str, schema: str, *, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, *, key: list[str], hash_of: str | None = None) -> StreamingQuery:
    """Append to a Parquet folder the rows that it doesn't have, by key and by the hash of a text column.

    Each batch is held against the whole target, so a key stays unique however
    late it comes again; an empty or missing target is one without rows.  It
    works off what is there and ends; the checkpoint resumes it. A batch is
    written to a folder of its own number, so that its repetition after a
    failure overwrites and doesn't double it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("content_hash", F.sha2(F.coalesce(F.col(hash_of), F.lit("")), 256)) if hash_of else batch
        ladder = [key, ["content_hash"]] if hash_of else [key]
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target))
        stored = spark.read.parquet(target).where(F.col("batch") != number).drop("batch") if there else rows.limit(0)
        insert_new(stored, rows, *ladder).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
