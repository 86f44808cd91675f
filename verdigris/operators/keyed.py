"""Rows by key: latest, first, numbered, carried forward, merged, deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order given, columns of the order last: a partial aggregate of structs, no window over a whole key.

    The order is ascending by all columns; turn one around by negating it.
    """
    rank = F.struct(*(o.alias(f"_{k}") for k, o in enumerate(order)))
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in df.columns if c not in keys)), rank).alias("_row"))
    return out.select(*keys, "_row.*").select(*df.columns)


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is largest by the order columns."""
    rank = F.struct(*order)
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), rank).alias("_row"))
    return out.select(*keys, "_row.*").select(*df.columns)


def first_n(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """Up to n rows of each key; Spark keeps n rows of a key in each task before it shuffles."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("position") <= n)


def attempts(df: DataFrame, key: str, *order: str, bucket: Column) -> DataFrame:
    """Number of each row within its key, in order.

    ``bucket`` cuts a key's rows into stretches and must not fall along the
    order, as a day does for times.  Rows are numbered within a stretch, after
    the counts of the stretches before it, so no task holds a whole key.
    """
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), before.alias("_before"))
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)))
    out = numbered.join(offsets, numbered[key].eqNullSafe(offsets["_k"]) & numbered["_b"].eqNullSafe(offsets["_c"]))
    return out.select(*df.columns, (F.col("_before") + F.col("_i")).cast("int").alias("attempt"))


def carry_forward(df: DataFrame, key: str, order: str, value: str, breaks: Column, *, bucket: Column) -> DataFrame:
    """value, or the last one before it in the key since the last row where ``breaks`` holds, as carried.

    ``bucket`` cuts a key's rows into stretches along the order.  What a stretch
    hands on is one row (whether it has a break, and the last value after it), so
    only these are brought in order for a whole key.
    """
    rows = df.withColumn("_b", bucket).withColumn("_break", breaks)
    w = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_part", F.sum(F.col("_break").cast("int")).over(w))
    rows = rows.withColumn("_own", F.last(value, ignorenulls=True).over(Window.partitionBy(key, "_b", "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    tail = rows.groupBy(key, "_b").agg(F.max("_part").alias("_breaks"), F.max_by(F.struct("_own"), F.struct("_part", order)).alias("_tail"))
    tail = tail.select(key, "_b", F.col("_tail._own").alias("_v"), F.sum((F.col("_breaks") > 0).cast("int")).over(Window.partitionBy(key).orderBy("_b")).alias("_part"))
    tail = tail.withColumn("_v", F.last("_v", ignorenulls=True).over(Window.partitionBy(key, "_part").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
    handed = tail.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.lag("_v").over(Window.partitionBy(key).orderBy("_b")).alias("_in"))
    out = rows.join(handed, rows[key].eqNullSafe(handed["_k"]) & rows["_b"].eqNullSafe(handed["_c"]))
    return out.select(*df.columns, F.coalesce("_own", F.when(F.col("_part") == 0, F.col("_in"))).alias("carried"))


def merge_last(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Both tables by key; new rows take the place of old ones. (An upsert; rows with equal keys within one table: the largest.)"""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("_new", *rest)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def flag_duplicates(df: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """df with duplicate_of: the smallest id with the same hash, null for that id itself."""
    first = df.groupBy(hash_col).agg(F.min(id_col).alias("_first"))
    return df.join(first, hash_col).withColumn("duplicate_of", F.when(F.col("_first") != F.col(id_col), F.col("_first"))).drop("_first")


def insert_new(stored: DataFrame, incoming: DataFrame, *ladder: list[str]) -> DataFrame:
    """Rows of incoming that stored has under none of the key lists of the ladder; of equal ones in incoming the first by all columns."""
    out = incoming
    for keys in ladder:
        out = out.join(stored.select(*keys).distinct(), keys, "left_anti")
    for keys in ladder:
        out = best_per_key(out, keys, *(F.col(c) for c in out.columns))
    return out


def replace_details(old: DataFrame, new: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """old without the detail rows of the headers, and new in their place."""
    return old.join(headers.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def delete(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """df without the rows of some keys; a null key deletes nothing."""
    return df.join(keys.select(*on).distinct(), list(on), "left_anti").select(*df.columns)


def deletions(wanted: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """key, refused: deletions asked for, refused where something refers to the key."""
    held = references.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_held", F.lit(True))
    return wanted.select(key).distinct().join(held, key, "left").select(key, F.col("_held").isNotNull().alias("refused"))
