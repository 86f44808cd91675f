"""Runs as keyed state: allowed and refused changes, retries after a timer, pauses, a stream that goes on after a stop."""

import time

import pytest

from verdigris.streaming import lifecycle

SCHEMA = "run_id string, n long, command string"


@pytest.mark.parametrize(
    "status,attempt,command,want",
    [
        ("pending", 0, "start", ("running", 1, True)), ("running", 1, "start", ("running", 1, False)), ("pending", 0, "complete", ("pending", 0, False)), ("running", 1, "complete", ("completed", 1, True)),
        ("completed", 1, "fail", ("completed", 1, False)), ("pending", 0, "fail", ("failed", 0, True)), ("running", 1, "error", ("waiting", 1, True)), ("running", 3, "error", ("failed", 3, True)), ("failed", 3, "start", ("failed", 3, False)),
        ("running", 1, "pause", ("paused", 1, True)), ("paused", 1, "resume", ("running", 1, True)), ("paused", 1, "complete", ("paused", 1, False)), ("running", 1, "nonsense", ("running", 1, False)), ("running", 1, None, ("running", 1, False)),
    ],
)
def test_steps(status, attempt, command, want):
    assert lifecycle.step(status, attempt, command, 3) == want


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def run(spark, tmp_path, until, limit=90):
    """Let the stream run until what it has put out is enough."""
    stream = lifecycle.lifecycle(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), attempts=2, delay_ms=300)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start(str(tmp_path / "out"))
    began = time.time()
    try:
        while time.time() - began < limit:
            query.processAllAvailable() if until is None else time.sleep(0.3)
            rows = [tuple(r)[:7] for r in spark.read.schema(lifecycle.OUTPUT).parquet(str(tmp_path / "out")).collect()]
            if until is None or until(rows):
                return rows
    finally:
        query.stop()
    raise AssertionError("the stream didn't get there in time")


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_stream(rocks, tmp_path):
    put(rocks, tmp_path, [("a", 1, "start"), ("a", 2, "error"), ("b", 1, "complete"), ("b", 2, "start"), ("b", 3, "start"), ("b", 4, "complete"), ("c", 1, "start"), ("c", 2, "error"), ("c", 3, "pause")])
    rows = run(rocks, tmp_path, lambda rows: any(r[2] == "retry" for r in rows))
    of = lambda k: [r[2:7] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0))]
    assert of("a") == [("start", "pending", "running", True, 1), ("error", "running", "waiting", True, 1), ("retry", "waiting", "running", True, 2)]
    assert of("b") == [("complete", "pending", "pending", False, 0), ("start", "pending", "running", True, 1), ("start", "running", "running", False, 1), ("complete", "running", "completed", True, 1)]
    assert of("c")[-1] == ("pause", "waiting", "paused", True, 1)  # a paused run isn't tried again
    # stopped and started again: the second failure of a is its last one, c goes on
    put(rocks, tmp_path, [("a", 3, "error"), ("a", 4, "start"), ("c", 4, "resume")])
    rows = run(rocks, tmp_path, lambda rows: sum(r[0] == "a" for r in rows) >= 5 and any(r[2] == "resume" for r in rows))
    assert of("a")[2:4] == [("error", "running", "failed", True, 2), ("start", "failed", "failed", False, 2)]
    assert of("c")[-1] == ("resume", "paused", "running", True, 1) and not any(r[0] == "c" and r[2] == "retry" for r in rows)
