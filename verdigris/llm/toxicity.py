"""Toxicity scores from subword-bag embeddings.

A word is the mean of the vectors of its character n-grams (with marks at both
ends) and of the word itself, a text the mean of its words, and a linear softmax
over it gives the classes.  Vectors and softmax are trained jointly in numpy, on
a bounded sample of labelled rows; an unseen misspelling shares most n-grams with
the word that it is made from.  As everything before the softmax is a mean, the
logits of a text are the mean of its words' logits: tasks keep those by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class from which the model is learned: those with the smallest hash of their id.
SAMPLE_ROWS = {1: 2500, 0: 3500}
#: Longer labelled texts (code points) are not learned from; they are scored like all others.
SAMPLE_CHARS = 10_000
SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 20
#: A bucket that fewer sampled texts have, or whose texts differ less from the others in class (in standard errors), stays
#: at zero: what a text says of its own words holds for no other.
MIN_TEXTS, MIN_Z = 8, 6.0
DIM = 10
EPOCHS, BATCH, RATE, DECAY = 15, 256, 0.03, 0.1
#: Toxic words are few among a text's words, so the mean is scaled before the softmax.
SCALE = 200.0
#: Words whose logits a worker remembers; beyond it starts afresh, which changes no score.
REMEMBER = 400_000
_WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)
#: Texts are taken together up to so many words.
_BLOCK = 200_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(salt)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, word by word, and how many each word has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    start = np.cumsum(size) - size
    at = np.arange(len(code)) - np.repeat(start, size)
    left = np.repeat(size, size) - at
    word = np.repeat(np.arange(len(words)), size)
    power = np.cumprod(np.r_[np.uint64(1), np.full(max(int(size.max()), *SIZES), _P)], dtype=np.uint64)
    found = [(np.arange(len(words)), _mixed(np.add.reduceat(code * power[at], start), 0))]
    for n in SIZES:
        if len(code) >= n:
            h = np.zeros(len(code) - n + 1, np.uint64)
            for j in range(n):
                h += code[j : len(code) - n + 1 + j] * power[j]
            whole = left[: len(h)] >= n
            found.append((word[: len(h)][whole], _mixed(h[whole], n)))
    word, bucket = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    order = np.argsort(word, kind="stable")
    return bucket[order], np.bincount(word, minlength=len(words))


class _Numbers(dict):
    """Number of each word; a new word gets the next one and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = len(self)
        return len(self) - 1


@dataclass
class Model:
    """buckets: those with a vector; vectors; softmax: a column for each class; bias."""

    buckets: np.ndarray
    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def logits(self) -> np.ndarray:
        """The logits of each of its buckets."""
        return (self.vectors @ self.softmax).astype(np.float32)


def _bags(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, bucket and weight of the n-grams of BATCH texts at a time; the weights of a text with words sum to one."""
    for lo in range(0, len(texts), BATCH):
        numbers = _Numbers()
        split = [words_of(t) for t in texts[lo : lo + BATCH]]
        flat = np.fromiter((numbers[w] for ws in split for w in ws), np.int64)
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        doc = np.repeat(np.arange(len(split)), lengths)
        bucket, count = grams(numbers.new)
        first, n = np.cumsum(count) - count, count[flat]
        places = np.repeat(first[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        # repeated n-grams of a text become one
        key, back = np.unique(np.repeat(doc, n) * BUCKETS + bucket[places], return_inverse=True)
        weight = np.bincount(back, weights=np.repeat(1.0 / (n * np.maximum(lengths[doc], 1)), n), minlength=len(key))
        yield lo + key // BUCKETS, key % BUCKETS, weight


def _telling(texts: list[str], target: np.ndarray) -> np.ndarray:
    """Buckets that enough texts have and whose texts differ in class from the others by MIN_Z standard errors at least; the rest stay at zero."""
    had = np.zeros((target.shape[1], BUCKETS), np.int32)
    for doc, bucket, _ in _bags(texts):
        for c in range(len(had)):
            had[c] += np.bincount(bucket[target[doc, c] == 1], minlength=BUCKETS).astype(np.int32)
    some = np.flatnonzero(had.sum(0) >= MIN_TEXTS)
    n = np.maximum(target.sum(0), 1)[:, None]
    share = had[:, some].sum(0) / n.sum()
    z = np.abs(had[:, some] / n - share) / np.sqrt(np.maximum(share * (1 - share), 1e-9) / n)
    return some[z.max(0) >= MIN_Z]


def train(texts: list[str], labels: list[int], *, epochs: int = EPOCHS, rate: float = RATE, classes: int = 2, seed: int = 1) -> Model:
    """Vectors and softmax by Adam on the cross-entropy, in batches; the same for the same rows in the same order."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    target = np.eye(classes, dtype=np.float32)[np.array([labels[i] for i in order], np.int64)]
    known = _telling(texts, target)
    place = np.full(BUCKETS, -1)
    place[known] = np.arange(len(known))
    # of the other buckets, whose vectors stay at zero, nothing is kept
    kept = [(d[k], place[b[k]], w[k] * SCALE) for d, b, w in _bags(texts) for k in [place[b] >= 0]]
    doc, bucket, weight = (np.concatenate([x[k] for x in kept]) if kept else np.zeros(0, np.int64) for k in range(3))
    vectors = rng.normal(0, 0.1, (len(known), DIM)).astype(np.float32)
    softmax = rng.normal(0, 1, (DIM, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    edges = np.searchsorted(doc, np.arange(0, len(texts) + BATCH, BATCH))
    params = [vectors, softmax, bias]
    moments, step = [(np.zeros_like(p), np.zeros_like(p)) for p in params], 0
    for epoch in range(epochs):
        for k in rng.permutation(len(edges) - 1).tolist():
            lo, hi, base = edges[k], edges[k + 1], k * BATCH
            y = target[base : base + BATCH]
            if not len(y):
                continue
            d, g, a = doc[lo:hi] - base, bucket[lo:hi], weight[lo:hi]
            by_bucket = vectors @ softmax
            logit = np.stack([np.bincount(d, weights=a * by_bucket[g, c], minlength=len(y)) for c in range(classes)], 1) + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            off = (p / p.sum(1, keepdims=True) - y) / len(y)
            pull = np.stack([np.bincount(g, weights=a * off[d, c], minlength=len(known)) for c in range(classes)], 1).astype(np.float32)
            gradients = [pull @ softmax.T, vectors.T @ pull, off.sum(0).astype(np.float32)]
            now = rate * (1 - epoch / epochs)
            step += 1
            for p_, (m, v), gradient in zip(params, moments, gradients, strict=True):
                m += 0.1 * (gradient - m)
                v += 0.01 * (gradient * gradient - v)
                p_ -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            vectors *= 1 - now * DECAY
    return Model(known, vectors, softmax * SCALE, bias)


def unlearned(counts: list[int]) -> Model:
    """Where a class has no rows: the classes' shares, with one row more of each, for every text."""
    bias = np.log(np.array(counts) + 1.0)
    return Model(np.zeros(0, np.int64), np.zeros((0, DIM), np.float32), np.zeros((DIM, len(counts)), np.float32), (bias - bias.max()).astype(np.float32))


class Scorer:
    """Scores texts; made once for each Python worker."""

    def __init__(self, buckets: np.ndarray, logits: np.ndarray, bias: np.ndarray):
        self.by_bucket, self.bias = np.zeros((BUCKETS, len(bias)), np.float32), bias
        self.by_bucket[buckets] = logits
        self.reset()

    def reset(self) -> None:
        self.numbers, self.by_word = _Numbers(), np.zeros((0, self.by_bucket.shape[1]))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each class for each text; a text without words is worth the bias alone."""
        if len(self.numbers) > REMEMBER:
            self.reset()
        split = [words_of(t) for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        number = self.numbers.__getitem__
        flat = np.fromiter((number(w) for ws in split for w in ws), np.int64, int(size.sum()))
        new, self.numbers.new = self.numbers.new, []
        if new:
            bucket, count = grams(new)
            sums = np.add.reduceat(self.by_bucket[bucket].astype(np.float64), np.cumsum(count) - count)
            self.by_word = np.concatenate([self.by_word, sums / count[:, None]])
        logit = np.tile(self.bias.astype(np.float64), (len(texts), 1))
        some = size > 0
        if some.any():
            start = (np.cumsum(size) - size)[some]
            logit[some] += np.add.reduceat(self.by_word[flat], start) / size[some, None]
        p = np.exp(logit - logit.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: dict[int, int] | None = None) -> DataFrame:
    """id, label, text of the labelled documents to learn from, at most as many of each class as ``rows`` says.

    An id with several labels has the largest, one with several texts the smallest
    text; rows without id, label or text, and texts over ``SAMPLE_CHARS``, aren't taken.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("label"))
    own = own.withColumn("h", F.xxhash64("id"))
    parts = [own.where(F.col("label") == label).orderBy("h", "id").limit(n) for label, n in (rows or SAMPLE_ROWS).items()]
    wanted = parts[0]
    for p in parts[1:]:
        wanted = wanted.unionByName(p)
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    # as many ids as the rows above at most
    return texts.join(F.broadcast(wanted), "id").groupBy("id", "label", "h").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    """A model from the rows that ``sample`` takes, which come to the driver."""
    got = sorted(sample(docs, labels, **columns).collect(), key=lambda r: (r["h"], r["id"]))
    marks = [r["label"] for r in got]
    counts = [marks.count(0), marks.count(1)]
    return train([r["text"] for r in got], marks) if all(counts) else unlearned(counts)


def probability(model: Model, text: Column) -> Column:
    """Score of a text column, 0 to 1."""
    buckets, logits, bias = model.buckets, model.logits(), model.bias

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        key = (len(buckets), logits.tobytes(), bias.tobytes())
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(buckets, logits, bias)
        out, held, size = [np.zeros(0)], [], 0
        for t in texts.to_pylist():
            held.append(t)
            size += len(t or "") // 5
            if size >= _BLOCK:
                out.append(_SCORERS[key](held)[:, 1])
                held, size = [], 0
        if held:
            out.append(_SCORERS[key](held)[:, 1])
        return pa.array(np.concatenate(out), pa.float64())

    return run(text)


_SCORERS: dict[tuple, Scorer] = {}


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row: doc_id, score, predicted (1 from the threshold on).

    * Null and empty texts, and texts without a word, get what the model says of no word: its bias.
    * Without labelled rows of one class, every score is the smoothed share of toxic rows.
    * Repeated rows are scored alike; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), probability(model, F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
