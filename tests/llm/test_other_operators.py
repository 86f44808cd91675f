"""Line dedup, packing, token counts, language ID, window removal and the pipeline on small tables."""

import random
import time
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from verdigris.llm import language_id, line_dedup, packing, substring_dedup, token_counts
from verdigris.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_lines int, n_chars long"
EDGES = [(900, None, 1, 0), (901, "", 1, 0), (902, " \t\x0b", 1, 3), (None, "no id", 1, 5), (903, "a\n\n B \nb\n", 1, 8), (903, "a\n\n B \nb\n", 1, 8), (904, "é 𝔘 <|endoftext|> #$% x", 1, 9), (905, "word " * 20_000, 1, 100_000)]


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r["doc_id"], r["text"], 1, r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return docs + EDGES


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(spark, rows, least):
    found = {}
    for d, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            found.setdefault(k, set()).add((d, t))
    gone = {k for k, v in found.items() if len(v) >= least}
    expected = [(d, len((t or "").split("\n")), sum(key(x) in gone for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if key(x) not in gone)) for d, t, *_ in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, line_dedup.dedup_lines(df, min_docs=least).collect()), key=repr) == sorted(expected, key=repr)
    kept = line_dedup.without_frequent_lines(df, length_col="n_chars", min_docs=least)
    assert kept.schema == df.schema
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.where("doc_id IS NOT NULL").collect()) == sorted((d, t) for d, _, n, t in expected if d is not None and (n == 0 or t.strip(" \t\n\x0b\x0c\r")))
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_packing_keeps_each_token_once(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(2), vocabulary("word_bpe_49k.json"), end_id=2, width=512).collect()
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t, *_ in rows}
    for r in out:  # every piece has the library's ids
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    sequences, docs = {}, {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    copies = {d: sum(x[0] == d for x in rows) for d in ids}
    for d in ids:
        assert sum(length for _, length, _ in docs[d]) == copies[d] * len(ids[d]), d
    assert packing.pack(spark.createDataFrame([], SCHEMA), vocabulary("word_bpe_49k.json"), end_id=2).count() == 0


def test_token_counts_equal_the_library(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = token_counts.count_tokens(spark.createDataFrame(rows, SCHEMA), vocabulary("piece_bpe_32k.model"), limit=4096).collect()
    want = [(d, len((t or "").encode()), len(sp.encode(t or ""))) for d, t, *_ in rows]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), vocabulary("piece_bpe_32k.model"), limit=4096).count() == 0


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    out = language_id.identify(docs, language_id.learn(docs.where(~language_id.held_out()))).withColumn("held", language_id.held_out())
    rows = out.where("held").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) and sum(r["rejected"] for r in rows) <= 0.03 * len(rows)
    edge = language_id.identify(spark.createDataFrame(EDGES[:3], SCHEMA), {}).collect()
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in edge)
    assert language_id.identify(spark.createDataFrame([], SCHEMA), {"a": b"x"}).count() == 0 and language_id.learn(docs.limit(0)) == {}
    clash = docs.limit(5).select("doc_id", "text", F.lit(1).alias("score"), F.lit("x").alias("lang_pred"))
    assert language_id.identify(clash, {"a": b"some text here", "b": b"some text here"}).select("score", "rejected").distinct().collect() == [(0.5, True)]  # a tie is rejected


def test_reference_removal_against_brute_force(spark):
    rnd = random.Random(4)
    words = lambda n: [rnd.choice("abcdefgh") for _ in range(n)]
    reference, docs = [words(60) for _ in range(4)], []
    for k in range(30):
        r, at = rnd.choice(reference), rnd.randrange(40)
        docs.append((k, " ".join(words(20) + r[at : at + 20] + words(20)), 0, 0))
    runs = {tuple(r[i : i + 8]) for r in reference for i in range(len(r) - 7)}
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.remove_reference(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(" ".join(r),) for r in reference], "text string"), window=8).collect()}
    for d, t, *_ in docs:
        w = t.split()
        gone = {i + j for i in range(len(w) - 7) if tuple(w[i : i + 8]) in runs for j in range(8)}
        assert got[d] == " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("text", ["a" * 100_000, "x" * 401 + " " + "y" * 400, "é😀\u0001" * 3000, "the" * 30_000, " " * 5000 + "word", "\n" * 2000 + "\t" * 2000])
def test_long_pre_tokens_equal_the_library(text):
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    assert token_counts.PieceCounter(vocabulary("piece_bpe_32k.model")).count([text]) == [len(library.encode(text))]


def test_a_million_characters_without_a_blank_take_linear_log_time():
    rng = random.Random(6)
    text = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    counter = token_counts.PieceCounter(vocabulary("piece_bpe_32k.model"))
    began = time.time()
    got = counter.count([text])
    assert time.time() - began < 30 and got == [len(library.encode(text))]


def test_long_and_short_merges_agree():
    rng = random.Random(7)
    counter = token_counts.PieceCounter(vocabulary("piece_bpe_32k.model"))
    words = ["".join(rng.choice("aeinrst▁🙂é") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    assert counter.merge(words).tolist() == [counter.merge_long(w) for w in words]
