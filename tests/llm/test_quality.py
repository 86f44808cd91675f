"""Quality rules: base counts and the Kneser-Ney model against plain Python, passes, bands and edges."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from verdigris.llm import quality
from verdigris.llm.common import materialise

SCHEMA = "doc_id long, text string, lang string, n_words int, kept string"
SF = "/root/testdata/sf0.01"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


class PlainModel:
    """Interpolated modified Kneser-Ney over dictionaries of strings."""

    def __init__(self, texts):
        n = quality.ORDER
        self.counts = {n: Counter(p[i : i + n] for t in texts for p in ["\n" * (n - 1) + t] for i in range(len(t)))}
        for k in range(n - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discounts, self.total, self.gamma = {}, {}, {}
        for k, counts in self.counts.items():
            n1, n2, n3, n4 = (sum(c == j for c in counts.values()) for j in (1, 2, 3, 4))
            ratio = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
            d = [max(quality.LEAST_DISCOUNT, min(j, j - (j + 1) * ratio * b / a if a else j / 2)) for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            total, taken = Counter(), defaultdict(float)
            for g, c in counts.items():
                total[g[:-1]] += c
                taken[g[:-1]] += d[min(c, 3) - 1]
            self.discounts[k], self.total[k], self.gamma[k] = d, total, {x: taken[x] / total[x] for x in total}

    def p(self, g):
        k = len(g)
        if not k:
            return quality.UNSEEN
        below, c = self.p(g[1:]), self.counts[k].get(g, 0)
        if g[:-1] not in self.total[k]:
            return below
        alpha = (c - self.discounts[k][min(c, 3) - 1]) / self.total[k][g[:-1]] if c else 0.0
        return alpha + self.gamma[k][g[:-1]] * below

    def log_ppl(self, t):
        p = "\n" * (quality.ORDER - 1) + t
        letters = sum(map(str.isalpha, t)) if self.counts[1] else 0
        return -sum(math.log(self.p(p[i : i + quality.ORDER])) for i in range(len(t))) / letters if letters else None


def corpus():
    rnd = random.Random(2)
    syllables = {"a": ["ba", "ke", "to", "ri", "na"], "b": ["шо", "ли", "пе", "ка", "😀"]}
    rows = []
    for k in range(60):
        lang = "ab"[k % 2]
        words = ["".join(rnd.choice(syllables[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.choice([3, 25, 60]))]
        rows.append((k, " ".join(words) + rnd.choice(["", ".", " x \ty", "\n12 34"]), lang, 0, ""))
    return rows + [(90, None, "a", 0, ""), (91, "", "a", 0, ""), (92, "12 !?", "a", 0, ""), (93, "text of no language", None, 0, ""), (None, "ba ke to " * 20, "a", 0, ""), (5, rows[5][1], "b", 0, ""), (94, "ba " * 50_000, "a", 0, "")]


def fold(t):
    return re.sub("[0-9]", "0", re.sub("[\t\x0b\x0c\r ]", " ", t.lower()))


@pytest.fixture(scope="module")
def assessed(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    return docs, quality.assess(docs, materialise=materialise).collect()


def test_base_counts_against_plain_python(assessed):
    rows = corpus()
    want = Counter((r[0], *plain_counts(r[1] or "")) for r in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in assessed[1]) == want
    for r in assessed[1]:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
        assert r["kept"] == (not r["base_failed"] and (r["log_ppl"] is None or r["ppl_low"] <= r["log_ppl"] <= r["ppl_high"]))
    rnd = random.Random(8)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b ", "a b c d e f g h\n", " ", "\n", "#", "é|", "\t", "x y\n"]) for _ in range(rnd.randrange(60)))
        assert quality.base_counts(text) == plain_counts(text)


def test_model_against_plain_kneser_ney(spark, assessed):
    docs, got = assessed
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")).withColumn("fold", F.pmod(F.xxhash64("text", F.lit(2)), F.lit(2))).collect()
    models = {(lang, f): PlainModel([fold(t["text"]) for t in texts if (t["lang"], t["fold"]) == (lang, f)]) for lang in ("a", "b", "und") for f in (0, 1)}
    want = sorted(((t["doc_id"], models[t["lang"], 1 - t["fold"]].log_ppl(fold(t["text"]))) for t in texts), key=repr)
    for (a, x), (b, y) in zip(want, sorted(((r["doc_id"], r["log_ppl"]) for r in got), key=repr), strict=True):
        assert a == b and (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-4)), (a, x, y)


def test_several_passes_give_the_same(spark, assessed, monkeypatch):
    monkeypatch.setattr(quality, "MODEL_BYTES", 3000)
    docs, got = assessed
    again = quality.assess(docs, materialise=materialise).collect()
    key = lambda r: repr(r["doc_id"])
    for x, y in zip(sorted(got, key=key), sorted(again, key=key), strict=True):
        assert (x["doc_id"], x["kept"], x["n_words"]) == (y["doc_id"], y["kept"], y["n_words"])
        assert x["log_ppl"] is y["log_ppl"] is None or math.isclose(x["log_ppl"], y["log_ppl"], rel_tol=1e-9)


def test_edges(spark):
    assert quality.assess(spark.createDataFrame([], SCHEMA), materialise=materialise).count() == 0
    one = quality.assess(spark.createDataFrame([(1, None, None, 0, "")], SCHEMA), materialise=materialise).collect()
    assert [(r["doc_id"], r["n_words"], r["base_failed"], r["kept"], r["log_ppl"]) for r in one] == [(1, 0, True, False, None)]


def test_bands_reject_junk_and_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id", "left_semi").where("size(split(text, ' ')) >= 60")
    rnd = random.Random(6)

    def letters_shuffled(t):
        return " ".join("".join(rnd.sample(w, len(w))) for w in t.split(" "))

    some = [(r["doc_id"], r["text"], r["lang"]) for r in clean.orderBy("doc_id").limit(60).collect()]
    spoil = (letters_shuffled, lambda t: t.replace(" ", "%% "), lambda t: t.replace(" ", " | "))
    junk = [(10**6 + k, spoil[k % 3](t), lang) for k, (_, t, lang) in enumerate(some)]
    out = quality.assess(docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string")), materialise=materialise)
    out = {r["doc_id"]: r for r in out.where("NOT base_failed").collect()}
    planted = [r for d, r in out.items() if d >= 10**6]
    kept = [out[d]["kept"] for d, *_ in some if d in out]
    assert sum(not r["kept"] for r in planted) >= 0.9 * len(planted) and sum(kept) >= 0.95 * len(kept)
