"""Language ID rejects narrow margins: ties, mixed texts and letter junk; clean held-out texts stay."""

import random

import pytest
from pyspark.sql import functions as F

from verdigris.llm import language_id

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def dicts(spark):
    return language_id.learn(spark.read.parquet(DOCS).where(~language_id.held_out()))


def rejected(spark, dicts, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = language_id.identify(docs, dicts)
    kept = language_id.known_language(docs, dicts).count()
    share = sum(r["rejected"] for r in out.collect()) / len(texts)
    assert kept == len(texts) - round(share * len(texts))
    return share


def test_ties_and_junk_go(spark, dicts):
    rnd = random.Random(2)
    junk = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n)) for n in (3, 30, 300, 3000) for _ in range(10)]
    assert rejected(spark, dicts, junk) == 1.0
    one = {"en": dicts["en"]}
    assert rejected(spark, one, junk) >= 0.9
    assert rejected(spark, {"en": dicts["en"], "copy": dicts["en"]}, ["the same dictionary twice is a tie " * 3]) == 1.0


def test_mixed_texts_go_and_clean_held_out_ones_stay(spark, dicts):
    held = spark.read.parquet(DOCS).where(language_id.held_out() & F.col("lang").isin("en", "fr") & (F.length("text") >= 600))
    texts = {k: sorted(r["text"] for r in held.where(F.col("lang") == k).collect()) for k in ("en", "fr")}
    assert rejected(spark, dicts, texts["en"] + texts["fr"]) <= 0.03
    one = {"en": dicts["en"]}
    assert rejected(spark, one, texts["en"]) <= 0.05
    classifier = language_id.Classifier(dicts)
    mixed = []
    for a, b in zip(texts["en"], texts["fr"]):
        n = min(len(a), len(b), 1500)
        share = range(5, 100, 5)  # somewhere between them is the text in which the two languages balance
        mixed.append(min((a[: n * k // 100] + " " + b[: n - n * k // 100] for k in share), key=lambda t: classifier(t)[2]))
    assert rejected(spark, dicts, mixed) >= 0.9


def test_pieces_come_from_all_over_and_only_they_are_collected(spark):
    text = "".join(f"{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}x " for k in range(5000))
    found = spark.createDataFrame([(1, text)], "h long, text string").select(language_id._pieces(100, F.lit(10)).alias("p")).first()["p"]
    places = sorted(text.index(p) for p in found) if len(set(found)) == 10 else []
    assert len(found) == 10 and all(len(p) == 100 and p in text for p in found) and places
    only = language_id.learn(spark.createDataFrame([(1, "a" * 3_000_000, "x")], "doc_id long, text string, lang string"), dict_bytes=1000, sample_piece=100)
    assert set(only) == {"x"} and len(only["x"]) <= 1000


def test_texts_without_a_letter_are_unknown():
    one = language_id.Classifier({"aa": b"some words of a language " * 50, "bb": "½ ²³ Ⅳ ① ٣ ".encode() * 50})
    for text in ("½ ²³ Ⅳ ①", "٣٤ ៣ 〇 ㊿", "12 + 34 = 46", "\u0301\u0302", "", None, "_ _"):
        assert one(text) == ("und", 0.0, 0.0, 0), text
    assert one("½ a")[0] != "und" and one("語")[0] != "und"
