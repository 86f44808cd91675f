"""Token counts by rank-synchronous merging of ragged arrays.

A batch's pre-tokens are held as one flat array of symbols with the sequence
each belongs to.  In every step each sequence merges its lowest-rank pair, all
sequences at once; the symbols that survive are the tokens.  A sequence of n
symbols takes up to n such steps, so the few that are longer than ``LONG`` keep
their pairs in a heap instead: the same merges in the same order, in linear-log time.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Pre-tokens whose counts a worker remembers; beyond it starts afresh, which changes no result.
REMEMBER = 700_000
#: Symbols merged at once.
BLOCK = 400_000
#: Symbols beyond which a pre-token is merged by itself.
LONG = 400
_NO_RANK = np.iinfo(np.int32).max


class PieceCounter:
    """Counts the tokens that a sentencepiece BPE model with byte fallback gives.

    Text is taken as it is but for a blank before it and blanks for spaces, so
    the model must have the identity normaliser; that is checked by the test
    against the library.  A symbol without a piece costs its UTF-8 bytes.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        pieces = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece goes on after a blank: words can't be counted one by one")
        scores = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        symbols = sorted({c for p in pieces for c in p} | set(pieces), key=lambda p: (len(p), p))
        self.number = {p: k + 1 for k, p in enumerate(symbols)}  # 0: a character of no piece
        self.base = len(symbols) + 1
        self.cost = np.array([0] + [1 if p in pieces else len(p.encode()) for p in symbols], dtype=np.int32)
        pairs = {}
        for p, score in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in self.number and p[k:] in self.number:
                    pairs[self.number[p[:k]] * self.base + self.number[p[k:]]] = (scores[score], self.number[p])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int32)
        self.pairs = pairs
        self.seen: dict[str, int] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; pairs that are no piece have the highest rank."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NO_RANK), np.where(hit, self.made[at], 0)

    def merge_long(self, word: str) -> int:
        """Tokens of one long pre-token: its pairs in a heap by rank and place, its symbols a linked list."""
        number, base, pairs = self.number, self.base, self.pairs
        symbol = [number.get(c, 0) for c in word]
        tokens = sum(len(c.encode("utf-8", "surrogatepass")) for c, s in zip(word, symbol, strict=True) if not s)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, a, b, found[1]) for i, (a, b) in enumerate(zip(symbol, symbol[1:], strict=False)) if (found := pairs.get(a * base + b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two is part of another merge by now
            symbol[i], symbol[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get(made * base + symbol[k]):
                    heapq.heappush(heap, (found[0], i, made, symbol[k], found[1]))
            if (h := before[i]) >= 0 and (found := pairs.get(symbol[h] * base + made)):
                heapq.heappush(heap, (found[0], h, symbol[h], made, found[1]))
        cost = self.cost.tolist()
        return tokens + sum(cost[s] for s in symbol if s >= 0)

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        number = self.number
        flat = "".join(words)
        symbol = np.fromiter((number.get(c, 0) for c in flat), dtype=np.int32, count=len(flat))
        word = np.repeat(np.arange(len(words)), lengths)
        tokens = np.zeros(len(words), dtype=np.int64)
        for k in np.flatnonzero(symbol == 0):
            tokens[word[k]] += len(flat[k].encode("utf-8", "surrogatepass"))
        rank = np.full(len(symbol), _NO_RANK, dtype=np.int32)
        made = np.zeros(len(symbol), dtype=np.int32)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same], made[same] = self.look_up(symbol[same], symbol[same + 1])
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            going = best != _NO_RANK
            size = np.diff(np.r_[starts, len(symbol)])
            if not going.all():  # words without a pair left are done
                done = np.repeat(~going, size)
                tokens += np.bincount(word[done], weights=self.cost[symbol[done]], minlength=len(tokens)).astype(np.int64)
                stay = ~done
                symbol, word, rank, made = symbol[stay], word[stay], rank[stay], made[stay]
                if not len(symbol):
                    break
                best, size = best[going], size[going]
                starts = np.r_[0, np.cumsum(size)[:-1]]
            # the leftmost pair of lowest rank of each word: what it makes may rank below the next one
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            symbol[at] = made[at]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            shift = at - np.arange(len(at))  # places after the removals
            symbol, word, rank, made = symbol[keep], word[keep], rank[keep], made[keep]
            rank[shift] = _NO_RANK
            last = len(symbol) - 1
            for here in (shift[(shift < last)], shift[shift > 0] - 1):
                here = here[word[here] == word[here + 1]]
                rank[here], made[here] = self.look_up(symbol[here], symbol[here + 1])
        return tokens

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; none for null and empty ones."""
        seen = self.seen
        split = [_WORD.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = list(set().union(*split).difference(seen))
        block, held = [], 0
        for w in new:
            if len(w) > LONG:
                seen[w] = self.merge_long(w)
                continue
            block.append(w)
            held += len(w)
            if held >= BLOCK:
                seen.update(zip(block, self.merge(block).tolist(), strict=True))
                block, held = [], 0
        if block:
            seen.update(zip(block, self.merge(block).tolist(), strict=True))
        out = [sum(map(seen.__getitem__, words)) for words in split]
        if len(seen) > REMEMBER:
            seen.clear()
        return out


_COUNTERS: dict[str, PieceCounter] = {}


def token_count(text: Column, model_file: str) -> Column:
    """Tokens of a text column, by the model file at the same path on every executor."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        if model_file not in _COUNTERS:
            _COUNTERS[model_file] = PieceCounter(model_file)
        counter, out = _COUNTERS[model_file], []
        for i in range(0, len(texts), 256):
            out += counter.count(texts.slice(i, 256).to_pylist())
        return pa.array(out, pa.int64())

    return run(text)


def count_tokens(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; repeated rows are counted
    alike; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), token_count(F.col("text"), model_file).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
