"""Counts gathered while rows go by, in batches and streams; trees of hashes over any partitioning."""

import hashlib

import pytest
from pyspark.sql import functions as F

from verdigris.operators import progress
from verdigris.operators import sampling as sp


def test_counts_of_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(1000).withColumn("odd", F.col("id") % 2 == 1)
    watched, counts = progress.counted(df, "numbers", odd=F.col("odd"), large=F.col("id") > 900, never=F.lit(None).cast("boolean"))
    watched.write.parquet(str(tmp_path / "out"))
    assert counts() == {"rows": 1000, "odd": 500, "large": 99, "never": 0}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000 and seen.value == 0
    watched, counts = progress.counted(df.limit(0), "none", odd=F.col("odd"))
    watched.collect()
    assert counts() == {"rows": 0, "odd": 0}


def test_counts_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = progress.counted_stream(stream, "ids", even=F.col("id") % 2 == 0).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = progress.progress(query, "ids")
    assert sum(r["rows"] for r in got) == 30 and sum(r["even"] for r in got) == 15 and len(got) >= 3


def plain(ids, width):
    ids = sorted({str(i) for i in ids if i is not None})
    digest = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    size = max(1, -(-len(ids) // width))
    blocks = {}
    for i in ids:
        blocks.setdefault(int(hashlib.sha256(i.encode()).hexdigest()[:8], 16) % size, []).append(i)
    level, levels = {b: digest(x) for b, x in blocks.items()}, 1
    while size > 1:
        size = -(-size // width)
        above = {}
        for b in sorted(level):
            above.setdefault(b // width, []).append(level[b])
        level, levels = {b: digest(x) for b, x in above.items()}, levels + 1
    return (next(iter(level.values())), len(ids), levels) if ids else (digest([]) if False else hashlib.sha256(b"").hexdigest(), 0, 0)


@pytest.mark.parametrize("n,width", [(0, 4), (5, 4), (300, 4), (300, 4096)])
def test_tree_hash(spark, n, width):
    ids = list(range(n)) + list(range(n // 2)) + [None]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    want = plain(ids, width)
    for parts in (1, 5):
        assert tuple(sp.tree_hash(df.repartition(parts).orderBy(F.rand(parts)), "id", width=width).first()) == want
    if n > 4:
        assert sp.tree_hash(df.where("id <> 3"), "id", width=width).first()["h"] != want[0]
