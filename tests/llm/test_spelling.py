"""Spelling variants against all pairs, at any limit of a hot segment; planted typos; odd rows."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from verdigris.llm import spelling as S

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    form, out = {}, {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = len(close)
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, out[w], words.get(form[w])))
    return sorted(rows, key=str)


def counted(docs, rate=97, least=5, often=3):
    count = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % rate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= often}


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [0, 10**6])
@pytest.mark.parametrize("alphabet,lengths", [("ab", (1, 7)), ("abé×", (1, 5)), ("abcdef", (5, 12))])
def test_pairs_are_all_pairs(spark, hot, alphabet, lengths):
    rng = random.Random(len(alphabet) + hot)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths))): rng.choice([3, 4, 8, 8, 40]) for _ in range(150)}
    for w in list(words)[:60]:  # close ones
        k = rng.randrange(len(w))
        words.setdefault(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]]) or "a", rng.choice([3, 20]))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in S.near_pairs(df, hot=hot).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if a < b and near(a, b))
    assert rows_of(S.variants(df, hot=hot)) == brute(words)


def test_many_words_of_one_ending_make_few_candidates(spark):
    words = [(f"{a}{b}{c}{d}heit", 3) for a in "abcde" for b in "abcde" for c in "vwxyz" for d in "vwxyz"]
    df = spark.createDataFrame(words, "word string, n long")
    assert S.near_pairs(df).count() == 625 * 16 // 2


def test_words_and_planted_typos(spark):
    rng = random.Random(8)
    bag = ["Straße", "STRASSE", "naïve", "Über", "hello", "World", "wOrld", "don't", "a×b÷c", "x1yyyyy2z", "ßßßßß", "Ünder"]
    docs = [(rng.choice([*range(40), None]), rng.choice([" ".join(rng.choice(bag) for _ in range(30)), None, "", "hello" * 3000])) for _ in range(200)]
    docs += docs[:20]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(0), "h": F.lit(0), "run": F.lit("")})
    got = {r["word"]: r["n"] for r in S.words(df, typo_rate=97).collect()}
    assert got == counted(docs)
    assert {r["word"]: r["n"] for r in S.words(df, typo_rate=3, min_length=4, min_count=1).collect()} == counted(docs, 3, 4, 1)


def test_forms_are_followed_to_the_last_and_ties_go_to_the_smallest(spark):
    chain = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "zbbbb": 33, "qqqqq": 3, "qqqqb": 6, "qqqqa": 6, "lonely": 9}
    got = rows_of(S.variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert got == brute(chain)
    by = {r[0]: r for r in got}
    assert by["aaaaa"][2] == by["aabbb"][2] == "zbbbb" and by["qqqqq"][1] == "qqqqa" and by["lonely"][1:3] == (None, "lonely")


def test_empty_tables(spark):
    assert rows_of(S.variants(spark.createDataFrame([], "word string, n long"))) == []
    assert rows_of(S.variants(S.words(spark.createDataFrame([], "doc_id long, text string"), typo_rate=97))) == []
    assert rows_of(S.variants(spark.createDataFrame([(None, 5), ("alone", 5)], "word string, n long"))) == [("alone", None, "alone", 5, 0, None)]
