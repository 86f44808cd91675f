"""Lines are hashed once: texts are read for their hashes and for what is kept, and for nothing else."""

import pyarrow as pa
from pyspark.sql import functions as F

from verdigris.llm import line_dedup

SCHEMA = "doc_id long, text string"


def test_texts_are_read_twice(spark):
    reads = spark.sparkContext.accumulator(0)

    def noted(texts: pa.Array) -> pa.Array:
        reads.add(len(texts))
        return texts

    docs = spark.createDataFrame([(k, f"seen often\nonly here {k}") for k in range(40)], SCHEMA)
    docs = docs.withColumn("text", F.arrow_udf(noted, "string").asNondeterministic()(F.col("text")))
    got = line_dedup.dedup_lines(docs, min_docs=10).collect()
    assert sorted((r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == sorted((2, 1, f"only here {k}") for k in range(40))
    assert reads.value == 80


def test_keys_of_odd_lines():
    texts = pa.array(["", " \t\x0b\f\r\n\n", "A É\n\x1c a\n a\n a \x0b\r\nA", "ı\nİ\nI"])
    got = line_dedup.line_hashes(texts).to_pylist()
    assert got[:2] == [[], []]
    hashes = {(i, x["pos"]): (x["a"], x["b"]) for i, row in enumerate(got) for x in row}
    assert list(hashes) == [(2, k) for k in range(5)] + [(3, k) for k in range(3)]
    assert hashes[2, 3] == hashes[2, 4]  # only the six ASCII characters are stripped, only A-Z lower-cased
    assert len(set(hashes.values())) == 7
    assert line_dedup.line_hashes(texts.slice(2, 1)).to_pylist() == got[2:3] and line_dedup.line_hashes(texts.slice(0, 0)).to_pylist() == []
