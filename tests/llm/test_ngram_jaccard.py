"""The similarity join against brute force."""

import random

import numpy as np
import pytest

from verdigris.llm import ngram_jaccard as nj

SCHEMA = "doc_id long, text string, n int, a long"


def brute(rows, size, percent):
    sets = []
    for _, text, *_ in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    rows, k = [], 0
    for _ in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 4, 8, 30, 60, 120, 200]))]
        if rnd.random() < 0.5:
            base[5:5] = passage
        for _ in range(rnd.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((k, " ".join(w).upper() if rnd.random() < 0.3 else "  ".join(w), 1, 2))
            k += 1
    return rows + [(k, None, 0, 0), (k + 1, "", 0, 0), (None, rows[3][1], 0, 0), (rows[5][0], rows[5][1], 0, 0), (rows[6][0], "another text under the same id", 0, 0)]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_against_brute_force(spark, size, percent, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 3)  # so that keys have several blocks
    rows = corpus(size)
    got = nj.similar_groups(spark.createDataFrame(rows, SCHEMA), words=size, percent=percent).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, size, percent)


def test_one_of_each_group(spark):
    text = " ".join(f"x{k}" for k in range(50))
    rows = [(1, text, 1, 1), (2, text.upper(), 1, 1), (2, text, 1, 1), (1, text, 1, 1), (3, None, 1, 1), (4, "other words here", 1, 1), (5, "", 1, 1)]
    kept = nj.one_of_each_group(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5] and kept.columns == ["doc_id", "text", "n", "a"]
    assert nj.similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_never_rules_out_a_similar_pair():
    rnd = np.random.default_rng(1)
    for n in (5, 400, 1995, 4498, 9000):
        x = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        cut = max(1, n // 25)
        y = np.unique(np.r_[x[cut:], rnd.integers(0, 1 << 63, cut // 2 + n // 100).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        group = nj._Group([len(x), len(y)], [nj.sketch(x), nj.sketch(y)], 90)
        assert 100 * both < 90 * (len(x) + len(y) - both) or list(group.may(0, np.array([1]))) == [1]
