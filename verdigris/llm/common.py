"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts: space and the ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where none is set, a local session gets a temporary one, as in tests; on a
    cluster, where no executor would see it, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="verdigris-"))
    return sc.getCheckpointDir()


#: Folders of the tables that materialise has written, in order.
_WRITTEN: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts lineage in a way that survives lost executors, and gives Spark
    the true size of an intermediate table before it plans the next join.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables there are; a mark for ``discard``."""
    return len(_WRITTEN)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the tables written since a mark, but for the last ``keep``: when what was made from them is a table itself."""
    jvm = spark.sparkContext._jvm
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    for path in gone:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _WRITTEN.remove(path)


#: Rows of a batch for Python where rows are whole texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Send Python at most BATCH_ROWS rows at a time from here on; a session that sends fewer keeps its number.

    Spark's 10,000 texts are 20 MB on average and more if texts are long; a task holds
    a batch in the JVM, in Arrow and as Python strings.  Results are the same.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:  # 0 or less: no bound
        spark.conf.set(key, str(BATCH_ROWS))


#: Key, source and model of what this worker keeps.
_HELD: tuple[Any, Any, Any] = (None, None, None)


def held_by_worker(key: tuple, make: Callable[[], Any], of: Any = None) -> Any:
    """What a Python worker keeps from task to task: the last model asked for, so that the models of different stages don't add up.

    ``of`` is what the model is made from, if the key names it by identity; it is held too.
    """
    global _HELD
    if _HELD[0] != key or _HELD[1] is not of:
        _HELD = (None, None, None)  # before the next is made
        _HELD = (key, of, make())
    return _HELD[2]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def with_row_key(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Keep id, text and more columns only, id and text as ``doc_id`` and ``text`` (null: empty), with ``row_key`` for joining back.

    Rows that agree in id and text are the same document; rows with one id and
    different texts are different documents.  A null id is a value like any other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), text.alias("text"), *more).withColumn(
        "row_key", F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    )
