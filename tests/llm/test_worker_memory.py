"""What a Python worker of the pipeline holds: one model, a compact pool of words, small batches."""

import gc
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa

import corpus_pipeline
from verdigris.llm import language_id, packing
from verdigris.llm.common import BATCH_ROWS
from verdigris.llm.queries import vocabulary

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_another_stage_frees_the_pool():
    pool = weakref.ref(packing.pool_of(vocabulary("word_bpe_49k.json"), 2))
    assert packing.pool_of(vocabulary("word_bpe_49k.json"), 2) is pool()
    dicts = {"en": b"some words", "de": b"einige Worte"}
    one = language_id._classifier(dicts)
    gc.collect()
    assert pool() is None
    assert language_id._classifier(dicts) is one and language_id._classifier(dict(dicts)) is not one


def test_a_word_of_the_pool_takes_few_bytes():
    pool = packing.IdPool(vocabulary("word_bpe_49k.json"), 2)
    pool.encode(pa.array(["warm up"]))
    gc.collect()
    tracemalloc.start()
    for k in range(0, 60_000, 6000):
        pool.encode(pa.array([" ".join(f"{np.base_repr(i, 26).lower()}word{i}," for i in range(k, k + 6000))]))
    gc.collect()
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(pool.words) > 60_000 and held / len(pool.words) < 190


def test_stages_send_small_batches(spark):
    docs, before = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.conf.get(BATCH)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name != "benchmark decontamination":
                spark.conf.set(BATCH, "10000")
                stage(spark, docs, "/root/testdata/sf0.001")
                assert spark.conf.get(BATCH) == str(BATCH_ROWS), name
        spark.conf.set(BATCH, "7")
        corpus_pipeline.lines(spark, docs, "/root/testdata/sf0.001")
        assert spark.conf.get(BATCH) == "7"
    finally:
        spark.conf.set(BATCH, before)
