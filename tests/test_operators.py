"""Known results, properties and edge cases of the operators."""

import datetime
import random
import random

import pytest
from pyspark.sql import functions as F

from verdigris.functions import dates, hashing, rates, text
from verdigris.operators import filters, keyed, matching, sampling, stats
from verdigris.streaming import ingest


def test_seeded_shuffle_has_its_locked_results():
    assert hashing.shuffled(list("ABCDEFGHIJ"), "legal-analytics-test")[:5] == ["B", "A", "J", "E", "F"]


def test_stratified_shuffle_has_its_locked_results(spark):
    rows = [(c, f"{c[0]}{k}") for c in ("东莞", "广州", "深圳") for k in range(1, 5)]
    df = spark.createDataFrame(rows, "city string, id string").withColumn("stratum", sampling.stratum_key("city"))
    allocation = sampling.balanced(df.groupBy("stratum").agg(F.count("*").alias("size")), 6)
    assert {r["allocated"] for r in allocation.collect()} == {2}
    rows = sampling.stratified_shuffle_sample(df, "id", allocation, "legal-analytics-stratified-test").orderBy("stratum", "position").collect()
    assert [r["id"] for r in rows] == ["东4", "东3", "广4", "广3", "深2", "深3"]


@pytest.mark.parametrize(("f", "sizes", "n", "expected"), [
    (sampling.proportional, [50, 30, 20], 10, [5, 3, 2]), (sampling.proportional, [1, 1, 1], 2, [1, 1, 0]), (sampling.balanced, [100, 100, 100], 60, [20, 20, 20]),
    (sampling.balanced, [100, 100, 100], 10, [4, 3, 3]), (sampling.balanced, [100, 100, 5], 45, [20, 20, 5]), (sampling.balanced, [3, 3], 6, [3, 3]),
])
def test_allocations(spark, f, sizes, n, expected):
    strata = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "stratum string, size long")
    assert [r["allocated"] for r in f(strata, n).orderBy("stratum").collect()] == expected


def test_allocations_sum_up_and_fit(spark):
    rnd = random.Random(2)
    for _ in range(4):
        sizes = [rnd.randrange(1, 50) for _ in range(rnd.randrange(1, 9))]
        n = rnd.randrange(1, sum(sizes) + 1)
        strata = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "stratum string, size long")
        for f in (sampling.proportional, sampling.balanced):
            rows = f(strata, n).collect()
            assert sum(r["allocated"] for r in rows) == n and all(0 <= r["allocated"] <= r["size"] for r in rows)


def test_samples_are_checked(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    for n in (0, -1, 5):
        with pytest.raises(ValueError):
            sampling.shuffle_sample(ids, "id", "s", n)
    with pytest.raises(ValueError):
        sampling.shuffle_sample(ids.union(ids), "id", "s", 2)
    assert sampling.candidate_hash(ids, "id") == hashing.sha256("a\nb\nc\nd")


def test_rates_and_outcomes(spark):
    rows = spark.createDataFrame([("x", "supported"), ("x", "unclear"), ("y", "unclear"), ("y", None)], "g string, o string")
    got = {r["g"]: r for r in stats.outcome_stats(rows, "o", "g").collect()}
    assert got["x"]["win_rate"] == 100.0 and got["x"]["known"] == 1 and got["y"]["win_rate"] is None and got["y"]["total"] == 2
    assert stats.outcome_stats(rows.limit(0), "o", "g").count() == 0
    cases = [(["supported", "unclear"], "supported", "unclear"), (["supported", "not_supported"], "partially_supported", "partially_supported"), ([], "unclear", "unclear")]
    df = spark.createDataFrame([(a,) for a, *_ in cases], "a array<string>")
    assert [tuple(r) for r in df.select(rates.merged_outcome(F.col("a")), rates.merged_outcome(F.col("a"), "any_unclear")).collect()] == [c[1:] for c in cases]


def test_dates_and_amounts(spark):
    df = spark.createDataFrame([("2023-02-29",), ("on 2024年2月9日",), ("1800/1/1",), (None,)], "t string")
    assert [r[0] for r in df.select(dates.calendar_date(F.col("t"))).collect()] == [None, datetime.date(2024, 2, 9), None, None]
    numbers = spark.createDataFrame([("十",), ("二十三",), ("二〇二四",), ("abc",)], "t string")
    assert [r[0] for r in numbers.select(dates.chinese_number(F.col("t"))).collect()] == [10, 23, 2024, None]
    money = spark.createDataFrame([("付 1,200.50元 和 3万元",)], "t string")
    assert money.select(dates.amounts(F.col("t"))).first()[0] == [1200.5, 30000.0]


def test_text(spark):
    df = spark.createDataFrame([("<p>a&amp;b</p><script>x</script><b>c</b>", "a  b\r\n\n\n\nc")], "h string, t string")
    row = df.select(text.clean_html(F.col("h")), text.normalise_blanks(F.col("t")), text.paragraphs(F.col("t"))).first()
    assert row[0] == "\na&b\nc" and row[1] == "a b\n\nc" and row[2] == ["a  b", "c"]


def test_keys_join_by_containment_and_are_bounded(spark):
    facts = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, None), (4, "zz")], "id int, tag string")
    assert sorted((r["id"], r["key"]) for r in matching.match_keys(facts, "tag", ["abc", "b"]).collect()) == [(1, "abc"), (1, "b"), (2, "abc"), (2, "b")]
    with pytest.raises(ValueError):
        matching.match_keys(facts, "tag", ["x"] * 1001)


def test_pages_and_merges(spark):
    df = spark.range(25)
    assert [r[0] for r in filters.page(df, 9, 10, "id").collect()] == [20, 21, 22, 23, 24] and filters.page(df.limit(0), 1, 10, "id").count() == 0
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = keyed.merge_last(old, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, keyed.merge_last(once, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_ingestion_keeps_keys_unique_and_resumes(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id long, text string"
    for rows in ([(1, "a"), (2, "b"), (2, "b")], [(2, "other"), (3, "a"), (4, "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(ingest.read_files(spark, source, schema), target, checkpoint, key=["id"], hash_of="text").awaitTermination()
    assert sorted((r["id"], r["text"]) for r in spark.read.parquet(target).collect()) == [(1, "a"), (2, "b"), (4, "d")]


def test_stretches_of_a_key_equal_the_whole_key(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, None, float(k)]), rnd.random() < 0.15) for k in range(300)]
    df = spark.createDataFrame(rows, "i long, k int, v double, b boolean")
    got = {r["i"]: r["carried"] for r in keyed.carry_forward(df, "k", "i", "v", F.col("b"), bucket=F.floor(F.col("i") / 7)).collect()}
    number = {r["i"]: r["attempt"] for r in keyed.attempts(df, "k", "i", bucket=F.floor(F.col("i") / 7)).collect()}
    state, seen = {}, {}
    for i, k, v, b in rows:
        if b:
            state[k] = None
        if v is not None:
            state[k] = v
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == state.get(k) and number[i] == seen[k], i
    assert keyed.attempts(df.limit(0), "k", "i", bucket=F.col("i")).count() == 0
