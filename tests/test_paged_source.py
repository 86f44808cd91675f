"""The paged source: whole reads, streams that are stopped and go on, failed pages, repeated fetches."""

import json

import pytest

from verdigris.sources import paged

NAMES = ["data", "items", "lawcases", "results"]


def put(folder, n, rows, broken=None):
    folder.mkdir(exist_ok=True)
    body = json.dumps({NAMES[n % 4]: [{"id": i, "name": f"n{i}"} for i in rows], "total": 100}, ensure_ascii=False)
    (folder / f"page-{n}.json").write_text(body if broken is None else broken)


@pytest.fixture
def source(spark):
    spark.dataSource.register(paged.PagedSource)
    return spark


def take(spark, folder, out, check, **options):
    """Run the stream until it has all pages that it can get, then stop it."""
    reader = spark.readStream.format("paged").option("pagesPerBatch", 2).option("wait", 0.01)
    for k, v in options.items():
        reader = reader.option(k, v)
    query = reader.load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(check)).trigger(processingTime="0 seconds").start(str(out))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def test_a_whole_read(source, tmp_path):
    for n in range(5):
        put(tmp_path / "p", n, range(n * 3, n * 3 + 3))
    put(tmp_path / "p", 5, [], broken='{"data": [1, 2')
    put(tmp_path / "p", 6, [], broken='{"rows": []}')
    put(tmp_path / "p", 7, [])
    df = source.read.format("paged").load(str(tmp_path / "p"))
    assert df.rdd.getNumPartitions() == 8  # one a page
    rows = df.collect()
    assert sorted(json.loads(r["row"])["id"] for r in rows if r["row"]) == list(range(15))
    assert {(r["page"], r["error"]) for r in rows if r["error"]} == {(5, "malformed"), (6, "no_rows")}
    assert all(r["total"] == 100 for r in rows if r["row"]) and {r["page"] for r in rows} == set(range(7))  # an empty page has no row


def test_a_stopped_stream_goes_on_at_the_next_page(source, tmp_path):
    pages, out, check = tmp_path / "p", tmp_path / "out", tmp_path / "check"
    for n in (0, 1, 2, 4):
        put(pages, n, [n])
    take(source, pages, out, check)
    seen = lambda: sorted((r["page"], r["row"] is not None) for r in source.read.parquet(str(out)).collect())
    assert seen() == [(0, True), (1, True), (2, True)]  # page 3 isn't there yet
    put(pages, 3, [], broken="<html>busy</html>")
    put(pages, 5, [5])
    put(pages, 0, [99])  # a page that was taken isn't taken again
    take(source, pages, out, check)
    assert seen() == [(0, True), (1, True), (2, True), (3, False), (4, True), (5, True)]
    take(source, pages, out, check)
    assert len(seen()) == 6


def test_a_fetch_is_tried_again(tmp_path, monkeypatch):
    put(tmp_path / "p", 0, [1])
    tries = []
    real = paged.fetch

    def shaky(root, path):
        tries.append(path)
        if len(tries) < 3:
            raise OSError("reset")
        return real(root, path)

    monkeypatch.setattr(paged, "fetch", shaky)
    part = paged.Page(0, str(tmp_path / "p" / "page-0.json"))
    assert [(r[0], r[4], r[5]) for r in paged._read(str(tmp_path), part, 3, 0.0)] == [(0, None, 3)]
    tries.clear()
    assert [(r[0], r[4], r[5]) for r in paged._read(str(tmp_path), part, 2, 0.0)] == [(0, "network", 2)]


def test_an_empty_folder(source, tmp_path):
    (tmp_path / "p").mkdir()
    assert source.read.format("paged").load(str(tmp_path / "p")).count() == 0
