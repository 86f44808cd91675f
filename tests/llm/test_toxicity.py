"""Toxicity against a plain version, with unseen misspellings and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import toxicity as T

RUDE = ["blockhead", "numbskull", "dimwitted", "scoundrel"]


def made(n, seed=3):
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice([8, 40, 200]))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(max(1, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(RUDE)
        rows.append((i, " ".join(words), toxic))
    return rows, plain


@pytest.fixture(scope="module")
def model():
    rows, _ = made(600)
    return T.train([r[1] for r in rows], [r[2] for r in rows])


def plain_score(model, text):
    """Loops over words and n-grams; n-grams are told apart by ``grams`` alone."""
    vector = {b: v for b, v in zip(model.buckets.tolist(), model.vectors, strict=True)}
    total, words = np.zeros(T.DIM), T.words_of(text)
    for w in words:
        bag = T.grams([w])[0].tolist()
        marked = f"<{w}>"
        assert len(bag) == 1 + sum(max(0, len(marked) - n + 1) for n in T.SIZES)
        total += sum((vector.get(b, np.zeros(T.DIM)) for b in bag), np.zeros(T.DIM)) / len(bag)
    logit = (total / len(words) if words else total) @ model.softmax + model.bias
    return 1 / (1 + math.exp(logit[0] - logit[1]))


def test_scores_are_those_of_the_plain_version(model):
    rows, _ = made(40, seed=9)
    texts = [r[1] for r in rows] + ["", None, "...", "Blockhead!", "É ñ 😀 x" * 50, "a" * 30_000, "\ud800 x"]
    got = T.Scorer(model.buckets, model.logits(), model.bias)(texts)[:, 1]
    assert got == pytest.approx([plain_score(model, t) for t in texts], abs=1e-4)


def test_equal_ngrams_have_equal_buckets_and_words_alone_or_together_the_same():
    words = ["banana", "ana", "a", "ananas"]
    bucket, count = T.grams(words)
    apart = [T.grams([w])[0].tolist() for w in words]
    edges = np.cumsum(count)
    assert [sorted(bucket[e - c : e].tolist()) for e, c in zip(edges, count, strict=True)] == [sorted(a) for a in apart]
    assert len(set(apart[0])) == len(apart[0]) - 1  # ana is in banana twice


def test_held_out_texts_and_misspellings(model):
    rows, plain = made(400, seed=11)
    score = T.Scorer(model.buckets, model.logits(), model.bias)
    got = score([r[1] for r in rows])[:, 1] >= 0.7
    marks = np.array([r[2] for r in rows]) == 1
    assert got[marks].mean() > 0.97 and got[~marks].mean() < 0.02
    clean = " ".join(plain[:25])
    for word in ("blockheads", "blokhead", "numbskul", "dimwited", "scoundrell"):
        assert score([f"{clean} {word}"])[0, 1] > score([clean])[0, 1] + 0.2, word


def test_training_is_the_same_twice():
    rows, _ = made(120)
    a, b = (T.train([r[1] for r in rows], [r[2] for r in rows], epochs=2) for _ in range(2))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.softmax, b.softmax)


def test_odd_rows(spark, model):
    docs = spark.createDataFrame([(1, "blockhead numbskull", "x"), (1, "blockhead numbskull", "y"), (None, "hello there", "z"), (2, None, "w"), (3, "", "v")], "doc_id long, text string, score string")
    out = T.score(docs, model)
    assert out.columns == ["doc_id", "score", "predicted"] and out.count() == 5
    rows = {(r["doc_id"], round(r["score"], 9), r["predicted"]) for r in out.collect()}
    assert len(rows) == 4  # the repeated row alike
    assert all(0 <= s <= 1 for _, s, _ in rows) and (1, 1) in {(i, p) for i, _, p in rows}
    assert T.score(docs.limit(0), model).count() == 0
    assert {r["h"] for r in docs.select(T.held_out().alias("h")).collect()} <= {True, False}


def test_sample_is_bounded_and_whole(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(7, "another"), (60, None), (61, "x" * (T.SAMPLE_CHARS + 1)), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(7, 0), (60, 1), (61, 1), (None, 1), (8, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = T.sample(docs, labels, rows={1: 10, 0: 5}).collect()
    assert sorted(r["label"] for r in got).count(0) == 5 and len(got) <= 15 and len({r["id"] for r in got}) == len(got)
    everything = {r["id"]: (r["label"], r["text"]) for r in T.sample(docs, labels).collect()}
    assert len(everything) == 50 and everything["7"] == (1, "another")


def test_without_labels_of_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in T.score(docs, T.learn(docs, none)).collect()] == pytest.approx([0.5, 0.5])
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert [r["score"] for r in T.score(docs, T.learn(docs, ones)).collect()] == pytest.approx([0.75, 0.75])
