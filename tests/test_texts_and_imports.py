"""Readers, writers, pieces, contracts and rules on small rows with every edge."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from verdigris.functions import contracts, dates, rules, unicode
from verdigris.functions.legal_tables import DEFENSES, DISPUTES, Rule
from verdigris.operators import matching
from verdigris.operators import provenance as pv
from verdigris.operators import records as rec
from verdigris.operators import sampling as sp
from verdigris.sources import exports, imports


def test_archives(spark):
    body = "<p>中文 é &amp; more</p>" * 20
    parts = [
        (1, f'Content-Type: multipart/related; boundary="x"\r\n\r\n--x\r\nContent-Type: text/html; charset="gb2312"\r\nContent-Transfer-Encoding: 8bit\r\n\r\n'.encode() + body.replace("é", "e").encode("gb18030") + b"\r\n--x\r\nContent-Type: text/html\r\n\r\n<p>small</p>\r\n--x--\r\n"),
        (2, b"Content-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>a=3Db=\r\nc</p>"),
        (3, b"Content-Type: text/plain\r\n\r\nno page"),
        (4, None),
        (5, b""),
        (6, b"Content-Type: text/html; charset=nonsense\r\n\r\n<p>x</p>"),
    ]
    got = {r["id"]: r["html"] for r in imports.read_archives(spark.createDataFrame([(k, b, "kept") for k, b in parts], "id int, content binary, note string")).collect()}
    assert got[1].strip() == body.replace("é", "e") and got[2].strip() == "<p>a=bc</p>" and got[3] is None and got[4] is None and got[5] is None and got[6].strip() == "<p>x</p>"


def test_recorded_pages(spark, tmp_path):
    for k, text in enumerate(['{"items":[{"id":1,"name":"a"},{"id":2}],"count":2}', '{"data":[]}', '{"data":[{"id":', '{"other":1}']):
        (tmp_path / f"{k}.json").write_text(text)
    rows = imports.page_rows(imports.recorded_pages(spark, str(tmp_path)), "id long, name string").collect()
    got = sorted((r["page"][-6:], r["error"], r["row"]["id"] if r["row"] else None) for r in rows)
    assert got == [("0.json", None, 1), ("0.json", None, 2), ("2.json", "malformed", None), ("3.json", "no_rows", None)]
    assert [imports.page_size(n) for n in (-1, 7, 900)] == [1, 7, 50]


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc'), (2, None)], "id int, t string")
    assert [r["line"] for r in exports.csv_lines(df, {"id": F.col("id"), "t": F.col("t")}).collect()] == ['"1","a ""b"" c"', '"2",""']
    exports.write_csv(df.coalesce(1), {"id": F.col("id"), "t": F.col("t")}, str(tmp_path / "out"))
    (file,) = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".txt"]
    assert file.read_bytes().decode("utf-8-sig").split("\r\n")[:2] == ['"id","t"', '"1","a ""b"" c"']


def test_pieces_are_lossless(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a", "b", "\n", "\n\n", "字"]) for _ in range(rnd.randrange(60))) for _ in range(200)] + ["x" * 50, "", None]
    for limit in (1, 7, 20):
        for t in texts:
            parts = unicode.cut(t, limit)
            assert "".join(parts) == (t or "") and all(0 < len(p) <= limit for p in parts)
    assert unicode.cut("aa\nbb\n\ncc dd", 9) == ["aa\nbb\n\n", "cc dd"]
    with pytest.raises(ValueError):
        unicode.pieces(F.col("t"), 0)
    df = spark.createDataFrame([("ﬁ１　 ①\n x",), (None,)], "t string")
    assert [r[0] for r in df.select(unicode.compatible(F.col("t"))).collect()] == [" ".join(unicodedata.normalize("NFKC", "ﬁ１　 ①\n x").split()), None]


def test_contracts(spark):
    contract = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"type": "integer"}}, "b": {"type": "string", "enum": ["x"]}}}
    cases = [('{"a":[1,"2",true]}', [("a[1]", "wrong_type"), ("a[2]", "wrong_type")]), ('{"b":"y","c":1}', [("a", "missing_required_field"), ("c", "extra_field_rejected"), ("b", "invalid_enum")]), ('{"a":null}', [("a", "null_not_allowed")]), ("nope", [("", "not_json")]), (None, [("", "not_json")]), ('{"a":[]}', [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    for r in df.select("i", contracts.broken(F.col("t"), contract).alias("x")).collect():
        assert [(x["path"], x["code"]) for x in r["x"]] == cases[r["i"]][1]
    assert len(contracts.violations({"a": ["x"] * 500}, contract)) == contracts.MOST_ERRORS


def test_rules(spark):
    texts = ["被申请人辩称：申请人连续旷工。经审理查明无。", "公司违法解除劳动合同\n并且单方解除，支付经济补偿金", "", None, "无关", "x" * 100_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r["k"]: r["x"] for r in df.select("k", rules.labels(F.col("text"), DISPUTES, 20, 30, 0.05).alias("x")).collect()}
    assert [x["name"] for x in got[0]] == ["旷工"]
    assert [(x["name"], x["confidence"]) for x in got[1]] == [("解除", 0.95), ("经济补偿", 0.9)] and got[1][0]["words"] == ["违法解除", "单方解除"] and "\n" not in got[1][0]["snippet"]
    assert not got[2] and not got[3] and not got[4] and not got[5]
    own = df.select("k", "text", rules.section(F.col("text"), "被申请人辩称[：:]", "经审理查明").alias("own"))
    found = {r["k"]: r["x"] for r in own.select("k", rules.labels_first([(F.col("own"), "patterns", 0, "own"), (F.col("text"), "context", 0.15, "text")], DEFENSES, 5, 15, 25).alias("x")).collect()}
    assert [(x["name"], x["source"], x["confidence"]) for x in found[0]] == [("旷工", "own", 0.9)] and not found[3]
    taken = df.select(rules.taken_in_turn(F.lit("加班工资和加班"), [("long", ["加班工资"]), ("short", ["加班"])])["found"].alias("x")).first()["x"]
    assert [(x["name"], x["count"]) for x in taken] == [("long", 1), ("short", 1)]
    assert Rule("a", ("b",)).weight == 0.9
    days = spark.createDataFrame([("二〇二三年八月十五日",), ("2020年2月30日",), ("",), (None,)], "t string")
    assert [str(r[0]) for r in days.select(dates.chinese_date(F.col("t"))).collect()] == ["2023-08-15", "None", "None", "None"]


def test_reviewed_sides_and_overlays(spark):
    df = spark.createDataFrame([(1, "unclear", "supported", "supported", None), (2, "unclear", "supported", "not_supported", None), (3, "supported", "unclear", "not_supported", "supported"), (4, "supported", "not_supported", None, None)], "k int, e string, r string, ne string, nr string")
    sides = rec.reviewed_sides(F.lit("employee"), *(F.col(c) for c in ("e", "r", "ne", "nr")))
    assert [tuple(r) for r in df.orderBy("k").select(*sides).collect()] == [("unclear", "supported"), ("not_supported", "supported"), ("not_supported", "supported"), ("supported", "not_supported")]
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    patches = spark.createDataFrame([(1, "x", 5), (1, "y", 7), (2, None, 1), (9, "z", 1)], "k int, v string, t int")
    once = rec.overlay(base, patches, ["k"], ["v"], "t")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, rec.overlay(once, patches, ["k"], ["v"], "t").collect())) == [(1, "y", 1), (2, "b", 2)]


def test_searches_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 2)
    rnd = random.Random(1)
    vectors = [(k, [rnd.gauss(0, 1) for _ in range(5)]) for k in range(30)] + [(40, [0.0] * 5), (41, None), (None, [1.0] * 5)]
    rows = spark.createDataFrame(vectors, "vec_id long, e array<double>")
    got = matching.nearest(rows, rows.where("vec_id % 7 = 0"), 3, id_col="vec_id", vector_col="e").collect()
    known = [(k, v) for k, v in vectors if k is not None and v and any(v)]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for q, v in known:
        if q % 7 == 0:
            best = sorted(((-round(sum(a * b for a, b in zip(v, w)) / norm(v) / norm(w), 6), k) for k, w in known if k != q))[:3]
            assert [(-r["cosine"], r["id"]) for r in sorted(got, key=lambda r: r["position"]) if r["query"] == q] == best
    docs = spark.createDataFrame([(0, "a b b"), (7, "A b"), (2, None), (3, ""), (4, "c"), (5, "b, b a!")], "doc_id long, text string")
    near = matching.similar_documents(docs, docs.where("doc_id % 7 = 0"), 2, id_col="doc_id", text_col="text").collect()
    assert sorted((r["query"], r["position"], r["id"], r["cosine"]) for r in near) == [(0, 1, 5, 1.0), (0, 2, 7, 0.948683), (7, 1, 0, 0.948683), (7, 2, 5, 0.948683)]
    assert matching.nearest(rows.limit(0), rows.limit(0), 3, id_col="vec_id", vector_col="e").count() == 0


def test_identities_and_hashes(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), (None, "a"), ("a", None)], "stored string, now string")
    out = pv.rebind(df, "stored", "now").collect()
    assert [(r["status"], r["bound"], r["history"]) for r in out] == [("verified", "a", []), ("identity_mismatch", "b", ["b"]), ("legacy_unverified", "a", []), ("identity_missing", "a", [])]
    ids = spark.range(100)
    assert sp.population_hash(ids, "id").first() == sp.population_hash(ids.orderBy(F.desc("id")), "id").first() != sp.population_hash(ids.limit(99), "id").first()
    assert sp.population_hash(ids.limit(0), "id").first()["n"] == 0
    analysed, blocked = pv.gated(ids, pv.issues(odd=F.col("id") % 2 == 1, large=F.col("id") > 50), lambda x: x.agg(F.count("*").alias("n")))
    assert analysed.first()["n"] == 26 and {r["reason"]: r["n"] for r in blocked.collect()} == {"odd": 50, "large": 49}
    assert json.loads(exports.json_lines(spark.createDataFrame([(1, None)], "a int, b string")).first()["value"]) == {"a": 1}
