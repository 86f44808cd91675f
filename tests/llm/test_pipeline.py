"""Every stage of the pipeline on its predecessor's output, against plain versions."""

import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from verdigris.llm import common
from verdigris.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).unionByName(spark.createDataFrame([(9001, None, None, "s", 0), (9002, "", "en", "s", 0), (None, "no id but words enough to be told apart by the stages of it", None, None, None)], docs.schema))
    docs = common.materialise(docs.unionByName(extra))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(common.materialise(stage(spark, out[-1], SF)))
    return out


def test_stages_keep_the_columns(outputs):
    for o in outputs[1:-1]:
        assert o.columns == outputs[0].columns
    counts = [o.count() for o in outputs[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]


def test_languages_without_letters_go(outputs):
    kept = outputs[1].collect()
    assert all(r["text"] and any(map(str.isalpha, r["text"])) for r in kept)


def test_one_document_of_each_group_stays(outputs):
    before, after = outputs[2].collect(), outputs[3].collect()
    sets = [shingles(r["text"]) for r in before]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(before):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    want = {r["doc_id"] for i, r in enumerate(before) if not sets[i] or least.get(find(i)) == r["doc_id"]}
    assert {r["doc_id"] for r in after} == want and len({r["doc_id"] for r in after if r["doc_id"]}) == len([r for r in after if r["doc_id"]])


def test_documents_with_benchmark_items_go(spark, outputs):
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    short = [next(iter(x)) for x in items if len(x) == 1 and len(next(iter(x))) < 5]

    def leaks(t):
        s = shingles(t)
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        own = {tuple(w[i : i + len(x)]) for x in short for i in range(len(w) - len(x) + 1)}
        return any(x and 100 * len(x & (s | own)) >= 80 * len(x) for x in items)

    before, after = outputs[3].collect(), {r["doc_id"] for r in outputs[4].collect()}
    assert after == {r["doc_id"] for r in before if not leaks(r["text"])}


def test_packing_takes_every_document_that_is_left(outputs):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    docs = {r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in outputs[4].collect()}
    tokens = {}
    for r in outputs[5].collect():
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == docs


def test_run_leaves_one_table(spark):
    before = common.written()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert common.written() == before + 1


def test_stages_take_an_empty_table(spark, outputs):
    docs = outputs[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
