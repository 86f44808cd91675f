"""Stored tables: changes by key, versions, writes that fail half-way, two writers, lookups that skip files."""

import pytest
from pyspark.sql import functions as F

from verdigris.sources.stored import Conflict, StoredTable

SCHEMA = "id long, name string, n int"


@pytest.fixture
def stored(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"))
    t.create(spark.createDataFrame([(i, f"n{i}", i % 7) for i in range(1000)] + [(5, "a", 0), (None, "none", 1)], SCHEMA), ["id"], buckets=8)
    return t


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_changes_by_key(spark, stored):
    before = rows(stored.read())
    assert len(before) == 1001 and before[5] == (5, "n5", 5)  # the larger of the two rows of 5
    m = stored.upsert(spark.createDataFrame([(7, "seven", 70), (5000, "new", 1), (7, "seven", 69), (None, "changed", 2)], SCHEMA))
    now = {r[0]: r for r in rows(stored.read())}
    assert len(now) == 1002 and now[7] == (7, "seven", 70) and now[5000] == (5000, "new", 1) and now[None] == (None, "changed", 2)
    stored.delete(spark.createDataFrame([(8,), (None,), (77777,)], "id long"))
    stored.insert_new(spark.createDataFrame([(7, "no", 0), (6000, "yes", 0)], SCHEMA))
    now = {r[0]: r for r in rows(stored.read())}
    assert 8 not in now and None not in now and now[7] == (7, "seven", 70) and now[6000] == (6000, "yes", 0) and len(now) == 1001
    assert rows(stored.read(1)) == before and stored.versions() == [1, 2, 3, 4] and m.version == 2


def test_a_change_writes_its_buckets_only(spark, stored):
    old = stored.manifest()
    new = stored.upsert(spark.createDataFrame([(7, "x", 0)], SCHEMA))
    assert sum(old.folders[b] != new.folders[b] for b in old.folders) == 1


def test_a_write_that_fails_leaves_the_table_whole(spark, stored):
    before, names = rows(stored.read()), stored.versions()
    bad = spark.createDataFrame([(i, "bad", i) for i in range(200)], SCHEMA).withColumn("n", F.when(F.col("id") == 150, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken"):
        stored.upsert(bad)
    assert rows(stored.read()) == before and stored.versions() == names

    def stop(m):
        raise OSError("disk full")

    broken = StoredTable(spark, stored.path)
    broken._commit = stop  # all files are written, the manifest isn't
    with pytest.raises(OSError):
        broken.upsert(spark.createDataFrame([(1, "lost", 1)], SCHEMA))
    assert rows(stored.read()) == before and stored.versions() == names
    stored.upsert(spark.createDataFrame([(1, "kept", 1)], SCHEMA))
    assert rows(stored.read())[1] == (1, "kept", 1)


def test_of_two_writers_one_is_told(spark, stored):
    other = StoredTable(spark, stored.path)
    held = stored.manifest()
    other.upsert(spark.createDataFrame([(1, "other", 1)], SCHEMA))
    stored.manifest = lambda version=None: held  # still at the version that it has read
    with pytest.raises(Conflict):
        stored.upsert(spark.createDataFrame([(2, "late", 1)], SCHEMA))
    now = {r[0]: r for r in rows(other.read())}
    assert now[1] == (1, "other", 1) and now[2] == (2, "n2", 2)
    with pytest.raises(Conflict):
        other.create(other.read(), ["id"])


def scanned(df):
    """Files that a plan reads, and rows that leave the scan, after it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, out = [plan], []
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("Scan parquet"):
            metrics = p.metrics()
            out.append((metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()))
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())] + ([p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [])
    return out


def test_a_lookup_reads_one_bucket_and_the_bloom_filter_spares_its_rows(spark, stored):
    assert rows(stored.lookup((7,))) == [(7, "n7", 0)]
    assert rows(stored.lookup((7,), (8,), (123456,))) == [(7, "n7", 0), (8, "n8", 1)]
    assert rows(stored.lookup((None,))) == [(None, "none", 1)] and rows(stored.lookup()) == []
    whole, one = scanned(stored.read()), scanned(stored.lookup((7,)))
    assert whole[0][0] == 8 and one[0][0] == 1 and len(stored.lookup((7,)).inputFiles()) == 1
    # an absent key within the bucket's range: its file is opened, the bloom filter leaves no row group to read
    t = StoredTable(spark, stored.path + "-even")
    t.create(spark.range(0, 20000, 2).select("id", F.lit("x").alias("name"), F.lit(1).alias("n")), ["id"], buckets=4)
    absent = scanned(t.lookup((10001,)))
    assert absent[0][0] == 1 and absent[0][1] == 0
    assert scanned(t.lookup((10002,)))[0][1] > 0


def test_vacuum(spark, stored):
    for i in range(3):
        stored.upsert(spark.createDataFrame([(i, "x", i)], SCHEMA))
    before = rows(stored.read())
    stored.vacuum(keep=1)
    assert stored.versions() == [4] and rows(stored.read()) == before
