"""The pipeline's line stage drops lines, never documents."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, n_chars long"


def test_no_document_goes_and_groups_of_copies_keep_their_text(spark):
    copy = "\n".join(f"line {k} of a text that was copied as it is many times over" for k in range(3))
    texts = [copy] * 24 + [f"all rights reserved\nthis text number {k} alone has only this line" for k in range(11)] + ["all rights reserved", None, ""]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], SCHEMA)
    out = corpus_pipeline.lines(spark, docs, "")
    assert out.schema == docs.schema
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    want = {k: t if t == copy or not t else t.replace("all rights reserved", "").lstrip("\n") for k, t in enumerate(texts)}
    assert got == {k: (t, len(t or "")) for k, t in want.items()}
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, out, "").collect()}
    assert kept & set(range(24)) == {0} and set(range(24, 35)) <= kept
