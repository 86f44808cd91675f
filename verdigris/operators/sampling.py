"""Populations, strata, allocations and reproducible samples.

Two algorithms: ``hash`` takes the ids with the smallest salted SHA-256, which
scales to any population (a top-k), and ``shuffle`` reproduces a seeded
Fisher-Yates shuffle exactly.  The latter is sequential by definition, so it
works on one stratum at a time and only up to MOST_SHUFFLED ids.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.hashing import shuffled, stratum_seed

#: Part of each stratum's seed, so a fixed value.
ALGORITHM = "stratified-seeded-v1"
MOST_SHUFFLED = 1_000_000


def hash_sample(df: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """n rows with the smallest hash of seed and id."""
    if n <= 0:
        raise ValueError(f"a sample of {n} rows")
    return df.withColumn("sample_key", F.sha2(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string")), 256)).orderBy("sample_key", id_col).limit(n)


def shuffle_sample(df: DataFrame, id_col: str, seed: str, n: int) -> list[str]:
    """n ids, in order, of the seeded shuffle; the ids must be distinct and at most MOST_SHUFFLED."""
    if n <= 0:
        raise ValueError(f"a sample of {n} ids")
    rows = df.select(F.col(id_col).cast("string")).limit(MOST_SHUFFLED + 1).collect()
    ids = [r[0] for r in rows]
    if len(ids) > MOST_SHUFFLED:
        raise ValueError(f"more than {MOST_SHUFFLED} ids: take hash_sample")
    if len(set(ids)) < len(ids):
        raise ValueError("ids repeat")
    if n > len(ids):
        raise ValueError(f"{n} of {len(ids)} ids")
    return shuffled(ids, seed)[:n]


def stratum_key(*dims: str, missing: str = "unknown") -> Column:
    """dim=value for each dimension, joined by |."""
    return F.concat_ws("|", *(F.concat(F.lit(f"{d}="), F.coalesce(F.nullif(F.trim(F.col(d).cast("string")), F.lit("")), F.lit(missing))) for d in dims))


def proportional(strata: DataFrame, n: int, key: str = "stratum", size: str = "size") -> DataFrame:
    """strata with allocated: n shared out by size, the largest remainders (ties: by key) getting what is left."""
    total = Window.partitionBy()
    exact = F.col(size) * n / F.sum(size).over(total)
    out = strata.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = F.lit(n) - F.sum("_floor").over(total)
    rank = F.row_number().over(total.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), key))
    return out.withColumn("allocated", (F.col("_floor") + (rank <= left).cast("long"))).drop("_exact", "_floor")


def balanced(strata: DataFrame, n: int, key: str = "stratum", size: str = "size") -> DataFrame:
    """strata with allocated: equal shares, no stratum more than it has; what full strata leave goes to the others, single units in key order.

    The common level is found from the sizes in ascending order: a stratum is
    full if the level that its successors could share isn't below its size.
    """
    by_size = Window.partitionBy().orderBy(size, key)
    count = F.count("*").over(Window.partitionBy())
    before = F.coalesce(F.sum(size).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    position = F.row_number().over(by_size)
    out = strata.withColumn("_share", (F.lit(n) - before) / (count - position + 1)).withColumn("_full", F.col(size) <= F.col("_share"))
    taken = F.sum(F.when(F.col("_full"), F.col(size)).otherwise(0)).over(Window.partitionBy())
    open_ = F.count_if(~F.col("_full")).over(Window.partitionBy())
    level = F.floor((F.lit(n) - taken) / F.nullif(open_, F.lit(0)))
    spare = (F.lit(n) - taken) - level * open_
    rank = F.row_number().over(Window.partitionBy("_full").orderBy(key))
    out = out.withColumn("allocated", F.when(F.col("_full"), F.col(size)).otherwise(level + (rank <= spare).cast("long")).cast("long"))
    return out.drop("_share", "_full")


def stratified_hash_sample(df: DataFrame, id_col: str, allocation: DataFrame, seed: str, key: str = "stratum") -> DataFrame:
    """The ids of each stratum with the smallest salted hashes, as many as it is allocated."""
    keyed = df.withColumn("sample_key", F.sha2(F.concat(F.lit(seed + ":"), F.col(key), F.lit(":"), F.col(id_col).cast("string")), 256))
    most = allocation.agg(F.max("allocated")).first()[0] or 0  # a literal bound lets each task keep that many of a stratum before the shuffle
    ranked = keyed.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("sample_key", id_col))).where(F.col("position") <= most)
    return ranked.join(allocation.select(key, "allocated"), key).where("position <= allocated").select(key, id_col, "position")


def stratified_shuffle_sample(df: DataFrame, id_col: str, allocation: DataFrame, seed: str, key: str = "stratum") -> DataFrame:
    """stratum, id, position of each stratum's seeded shuffle; one stratum, of at most MOST_SHUFFLED ids, is held at a time."""
    sizes = df.groupBy(key).count().where(F.col("count") > MOST_SHUFFLED).limit(1).collect()
    if sizes:
        raise ValueError(f"stratum {sizes[0][0]} has more than {MOST_SHUFFLED} ids: take stratified_hash_sample")

    def one(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["allocated"].iloc[0])
        ids = shuffled(list(rows["id"]), stratum_seed(seed, group[0], ALGORITHM))[:n]
        return pd.DataFrame({"stratum": group[0], "id": ids, "position": range(1, len(ids) + 1)})

    rows = df.join(allocation.select(key, "allocated"), key).select(F.col(key).alias("stratum"), F.col(id_col).cast("string").alias("id"), "allocated")
    return rows.groupBy("stratum").applyInPandas(one, "stratum string, id string, position int")


def candidate_hash(df: DataFrame, id_col: str) -> str:
    """SHA-256 of all ids in ascending order, one to a line.

    That is sequential by definition, so it takes at most MOST_SHUFFLED ids,
    checked; population_hash has no such bound.
    """
    rows = df.select(F.col(id_col).cast("string")).limit(MOST_SHUFFLED + 1).collect()
    if len(rows) > MOST_SHUFFLED:
        raise ValueError(f"more than {MOST_SHUFFLED} ids: take population_hash")
    return hashlib.sha256("\n".join(sorted(r[0] for r in rows)).encode()).hexdigest()


def population_hash(df: DataFrame, id_col: str) -> DataFrame:
    """h, n: a hash of the set of ids in any order, in one partial and one final aggregate: SHA-256 of the sums of the eight words of each id's SHA-256."""
    digest = F.sha2(F.col(id_col).cast("string"), 256)
    words = [F.coalesce(F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")), F.lit(0)).alias(f"w{k}") for k in range(8)]
    return df.agg(F.count("*").alias("n"), *words).select(F.sha2(F.concat_ws(":", *(F.col(f"w{k}").cast("string") for k in range(8))), 256).alias("h"), "n")


def tree_hash(df: DataFrame, id_col: str, *, width: int = 4096) -> DataFrame:
    """h, n, levels: a hash of the ordered set of ids of any size, as a tree of hashes.

    The SHA-256 of an id places it in one of enough blocks for about ``width`` ids
    each; a block is the hash of its ids in order, one to a line, and every
    ``width`` blocks in order are one on the level above, until one is left.  Places
    depend on the ids and their number alone, so neither partitions nor the order
    of rows matter, a repeated id counts once, and no task holds more than a block.
    """
    ids = df.select(F.col(id_col).cast("string").alias("id")).where(F.col("id").isNotNull()).distinct().withColumn("d", F.sha2("id", 256))
    n = ids.count()
    size = max(1, -(-n // width))
    place = (F.conv(F.substring("d", 1, 8), 16, 10).cast("long") % size).alias("block")
    line = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    level = ids.groupBy(place).agg(line("id").alias("h"))
    levels = 1
    while size > 1:
        size = -(-size // width)
        rows = level.groupBy(F.floor(F.col("block") / width).alias("block"))
        level = rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), "\n"), 256).alias("h"))
        levels += 1
    if not n:
        return df.sparkSession.createDataFrame([(hashlib.sha256(b"").hexdigest(), 0, 0)], "h string, n long, levels int")
    return level.select("h", F.lit(n).alias("n"), F.lit(levels).alias("levels"))
