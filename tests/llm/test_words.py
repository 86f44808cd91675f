"""Words and windows of many texts at once against one text at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest

from verdigris.llm import substring_dedup, words
from verdigris.llm.words import Words, chunks

PARTS = ["a", "b", " ", "\t", "\n", "\x0b", "\x0c", "\r", "é", "漢", "\x1c", "\xa0", "xyz" * 3, "q" * 30, "Z" * 70]


def texts(rnd, parts, n, most):
    return [None if rnd.random() < 0.1 else "".join(rnd.choice(parts) for _ in range(rnd.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
def test_words_of_odd_texts(monkeypatch, size):
    monkeypatch.setattr(words, "CHUNK", size)
    rnd = random.Random(1)
    rows = texts(rnd, PARTS, 500, 20)
    split = [(t or "").encode().split() for t in rows]
    hashes, seen = {}, 0
    for row, got in chunks(pa.array(["before", *rows, "after"]).slice(1, len(rows))):
        assert row == seen
        stay = np.array([rnd.random() < 0.6 for _ in got.text], bool)
        number, joined = got.joined(stay)
        joined.validate(full=True)
        for k in range(len(got.first) - 1):
            mine = slice(got.first[k], got.first[k + 1])
            assert split[seen] == [got.data[i:j].tobytes() for i, j in zip(got.start[mine], got.stop[mine], strict=True)]
            assert all(hashes.setdefault(w, h) == h for w, h in zip(split[seen], got.hashes()[mine].tolist(), strict=True))
            kept = [w for w, yes in zip(split[seen], stay[mine], strict=True) if yes]
            assert (number[k], joined[k].as_py()) == (len(kept), b" ".join(kept).decode())
            seen += 1
    assert seen == len(rows) and len(set(hashes.values())) == len(hashes)
    assert list(chunks(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("window", [4, 7, 20])
def test_anchors_once_for_each_place(window):
    half, rnd = window // 2, random.Random(window)
    rows = [*texts(rnd, ["a ", "b "], 60, 80), "a " * 100, "c", "a " * (window - 1), "a " * window]
    small = {}

    def anchors(text):
        w = Words(pa.array([text], pa.string()))
        h = substring_dedup._runs(w.hashes(), half).tolist()
        small.update({tuple((text or "").split()[i : i + half]): x for i, x in enumerate(h)})
        spans = [range(i, i + window - half + 1) for i in range(len(w.text) - window + 1)]
        return [h[i] for i in sorted({min(s, key=lambda i: (h[i], i)) for s in spans})]

    want = [x for t in rows for x in anchors(t)]
    assert substring_dedup.Windows(Words(pa.array(rows)), window).places().tolist() == want
    assert len(set(small.values())) == len(small)


def test_many_texts_take_the_steps_of_one(monkeypatch):
    calls = []
    real = substring_dedup.mix
    monkeypatch.setattr(substring_dedup, "mix", lambda x: calls.append(len(x)) or real(x))
    for n in (1, 2000):
        for _, got in chunks(pa.array([" ".join("abcdefghijklmnopqrstuvwxyz")] * n)):
            windows = substring_dedup.Windows(got, 20)
            windows.hashes(np.flatnonzero(windows.whole))
    assert [len(calls), calls[1], calls[4]] == [6, 7, 14_000]
