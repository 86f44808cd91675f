"""Streams against the same functions on tables: late events, repeated keys, joins, counters."""

import datetime

from verdigris.streaming import events as ev

SCHEMA = "event_id long, user_id long, event_type string, ts timestamp_ntz, value double"


def at(minute):
    return datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute)


def feed(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, tmp_path, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_late_events_are_dropped(spark, tmp_path):
    batches = [[(1, 1, "a", at(1), 1.0), (2, 1, "a", at(50), 2.0)], [(3, 1, "a", at(200), 4.0)], [(7, 1, "a", at(201), 0.0)], [(4, 1, "a", at(2), 8.0)], [(5, 1, "a", at(400), 16.0)], [(6, 1, "a", at(401), 32.0)]]
    stream = feed(spark, str(tmp_path / "in"), batches)
    run(ev.tumbling(stream, "1 hour", late="30 minutes"), "windows", tmp_path, "append")
    got = {r["start"].hour: r["total"] for r in spark.table("windows").collect()}
    assert got[10] == 3.0 and got[13] == 4.0  # the event at minute 2 came after its window was closed


def test_repeated_keys_come_once(spark, tmp_path):
    batches = [[(1, 1, "a", at(1), 1.0), (1, 1, "a", at(1), 1.0)], [(1, 1, "a", at(3), 1.0), (2, 1, "a", at(4), 1.0)]]
    stream = feed(spark, str(tmp_path / "in"), batches)
    run(ev.deduplicated(stream, ["event_id"], "1 hour"), "once", tmp_path, "append")
    assert sorted(r["event_id"] for r in spark.table("once").collect()) == [1, 2]
    assert ev.deduplicated(spark.createDataFrame(batches[0], SCHEMA), ["event_id"], "1 hour").count() == 1


def test_joins_within_a_time_equal_the_batch(spark, tmp_path):
    rows = [(k, k % 3, "click" if k % 2 else "purchase", at(7 * k), 1.0) for k in range(40)]
    table = spark.createDataFrame(rows, SCHEMA)
    split = lambda df: (df.where("event_type = 'purchase'"), df.where("event_type = 'click'"))
    stream = feed(spark, str(tmp_path / "in"), [rows[:20], rows[20:]])
    run(ev.within_before(*split(stream), "user_id", "1 hour", late="10 minutes"), "pairs", tmp_path, "append")
    want = sorted(map(tuple, ev.within_before(*split(table), "user_id", "1 hour").collect()))
    assert want and sorted(map(tuple, spark.table("pairs").collect())) == want


def test_running_counters(spark, tmp_path):
    rows = [(k, k % 2, "error" if k % 3 == 0 else "view", at(k), 1.0) for k in range(10)]
    stream = feed(spark, str(tmp_path / "in"), [rows[:5], rows[5:]])
    run(ev.running_counters(stream), "counts", tmp_path, "complete")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, ev.running_counters(spark.createDataFrame(rows, SCHEMA)).collect()))
