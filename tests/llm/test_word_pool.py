"""A worker's tasks share the words that it has encoded."""

import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from verdigris.llm import packing
from verdigris.llm.queries import vocabulary


class Rows:
    """Stands for a table, and hands out the function that its partitions would go through."""

    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_later_tasks_encode_new_words_only(spark, monkeypatch):
    encoded = []
    real = packing.IdPool._encode_parts
    monkeypatch.setattr(packing.IdPool, "_encode_parts", lambda self: encoded.extend(self.parts.new) or real(self))
    run = packing.pack(Rows(), vocabulary("word_bpe_49k.json"), end_id=2, width=64)

    def task(*texts):
        encoded.clear()
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
        return [row for out in run(iter([batch])) for row in out.to_pylist()], sorted(x.decode() for x in encoded)

    first, _ = task("qzxv one, Two ÉTÉ two", None)
    again, new = task("qzxv one, Two ÉTÉ two", None)
    assert again == first and new == []
    assert task("one two qqzzxx!")[1] == ["!", "qqzzxx"]


def test_a_pool_that_failed_starts_anew(monkeypatch):
    pool = packing.IdPool(vocabulary("word_bpe_49k.json"), 2)
    want = [x.tolist() for x in pool.encode(pa.array(["some words. here", None]))]
    pool.reset()
    with monkeypatch.context() as patch:
        patch.setattr(packing.IdPool, "_encode_parts", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            pool.encode(pa.array(["some words. here"]))
    assert [x.tolist() for x in pool.encode(pa.array(["some words. here", None]))] == want


def test_numbers_of_words_in_a_full_table():
    numbers, seen = packing._Numbers(), {}
    for k in range(12):  # the table grows twice; words of 9 to 16 bytes share their first eight
        texts = [f"word{i} commonhead{i}" for i in range(k * 5000, k * 5000 + 7000)] + [None, "", "x" * 100 + str(k % 3)]
        got = numbers.of(packing.Words(pa.array(texts))).tolist()
        words = [w for t in texts for w in (t or "").split()]
        assert all(seen.setdefault(w, n) == n for w, n in zip(words, got, strict=True))
    assert sorted(seen.values()) == list(range(1, len(seen) + 1)) and len(numbers) == len(seen) + 1
    assert [w.decode() for w in numbers.new] == sorted(seen, key=seen.get)
