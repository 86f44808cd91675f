"""Every query of the operators against its SQL, and what those without SQL return."""

import os

import duckdb
import pytest

from verdigris.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_html_text": ["page_id", "url", "text", "n_chars"], "op3_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op6_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op8_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op9_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_toxicity": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    got = duck.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


def test_all_other_queries_have_their_columns(spark):
    assert set(COLUMNS) | set(queries.oracle_sql()) == set(queries.queries())
    df = queries.queries()["op11_toxicity"](spark, SF)
    assert df.columns == COLUMNS["op11_toxicity"] and dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and df.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> (score >= 0.7)::int").count() == 0
