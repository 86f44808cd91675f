"""Order-preserving packing of documents into training sequences.

Each partition's token stream, in the order of its rows, is cut into blocks that
end with a document.  Within a block dynamic programming chooses the cuts among
document ends, sentence ends and, in long stretches without either, every
``GAP`` tokens, minimising padding plus penalties for truncation.  The window of
possible predecessors slides with the sequence length, so the best of them comes
from a monotone queue in constant time.  Nothing is shuffled: a partition needs
no other's rows, and holds one block of ids at a time.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import held_by_worker
from verdigris.llm.words import Words

SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Costs in tokens: a cut at a sentence's end, a cut elsewhere, any sequence at all.
SENTENCE_CUT, HARD_CUT, SEQUENCE = 4, 24, 8
GAP = 256
#: Tokens after which a block ends with its document.
BLOCK = 1 << 20
#: Words whose ids a worker remembers, at less than 190 bytes each with their parts; then it starts anew.
REMEMBER = 400_000
_MARKS = b".,;:!?*&%#$|"
_SENTENCE_END = (b".", b"!", b"?", b'."', b'!"', b'?"')


def _letters(word: bytes) -> bool:
    """Whether the tokenizer, which composes and lower-cases first, sees letters alone."""
    if word.isascii():
        return word.isalpha()
    text = word.decode("utf-8", "replace")
    return text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()


class _Numbers:
    """Number of each word by its hash, first bytes and size, which tell words of up to 16 bytes apart without fail; whole arrays of words at once.

    An open table: a word's number is in the first free slot from its hash on.
    New words get the next numbers and are noted.
    """

    def __init__(self) -> None:
        self.new: list[bytes] = []
        self.keys = [np.zeros(1, np.uint64)] * 3  # number 0 is no word
        self.slots = np.full(1 << 16, -1, np.int32)

    def __len__(self) -> int:
        return len(self.keys[0])

    def _find(self, keys: list[np.ndarray]) -> np.ndarray:
        out, rows = np.full(len(keys[0]), -1, np.int64), np.arange(len(keys[0]))
        at = (keys[0] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(rows):
            there = self.slots[at]
            same = there > 0
            for held, k in zip(self.keys, keys, strict=True):
                same &= held[there] == k[rows]
            out[rows[same]] = there[same]
            on = (there > 0) & ~same
            rows, at = rows[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def _insert(self, numbers: np.ndarray) -> None:
        at = (self.keys[0][numbers] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            on = self.slots[at] != numbers
            numbers, at = numbers[on], (at[on] + 1) & (len(self.slots) - 1)

    def of(self, words: Words) -> np.ndarray:
        keys = [words.hashes(), words.heads(), (words.stop - words.start).astype(np.uint64)]
        out, raw = self._find(keys), words.data.tobytes()
        while len(missing := np.flatnonzero(out < 0)):
            first = np.sort(missing[np.unique(keys[0][missing], return_index=True)[1]])
            self.new += [raw[i:j] for i, j in zip(words.start[first].tolist(), words.stop[first].tolist(), strict=True)]
            n = len(self)
            self.keys = [np.r_[held, k[first]] for held, k in zip(self.keys, keys, strict=True)]
            if 2 * len(self) > len(self.slots):
                self.slots, n = np.full(4 << len(self).bit_length(), -1, np.int32), 1
            self._insert(np.arange(n, len(self)))
            out[missing] = self._find([k[missing] for k in keys])
        return out


class _Ragged:
    """Rows of ids, one after the other."""

    def __init__(self) -> None:
        self.ids, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def append(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.start = np.r_[self.start, (len(self.ids) + np.cumsum(size) - size).astype(np.int32)]
        self.size = np.r_[self.size, size.astype(np.int32)]
        self.ids = np.concatenate([self.ids, ids.astype("<u4")])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some rows in a row, and where each ends."""
        size = self.size[rows].astype(np.int64)
        after = np.cumsum(size)
        return self.ids[np.repeat(self.start[rows] - (after - size), size) + np.arange(after[-1] if len(after) else 0)], after


class IdPool:
    """Ids of white-space separated words, each encoded once; texts are looked up as arrays.

    The tokenizer splits at white space and between letters and marks before
    anything else, and lower-cases, so a text's ids are those of its words in a
    row, and a word's those of its letters and of the marks after them.  Only
    words of that simple shape are taken apart.  A test holds that against the library.
    """

    def __init__(self, tokenizer_file: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks; threads would take others' cores
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(tokenizer_file), end_id
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        """Word 0 is the end of a document, part 0 is empty."""
        self.words, self.parts = _Numbers(), _Numbers()
        self.word_ids, self.part_ids, self.ends = _Ragged(), _Ragged(), np.zeros(1, bool)
        self.word_ids.append(np.array([self.end_id]), np.ones(1, np.int64))
        self.part_ids.append(np.zeros(0), np.zeros(1, np.int64))

    def _encode_parts(self) -> None:
        new, self.parts.new = self.parts.new, []
        alone = [_letters(x) for x in new]
        letters = [k for k, yes in enumerate(alone) if yes]
        size = np.zeros(len(new), np.int64)
        got: list[np.ndarray] = [np.zeros(0, np.int64)] * len(new)
        for i in range(0, len(letters), 2000):  # words of letters alone go together: each ends with one end-of-word id
            some = letters[i : i + 2000]
            flat = np.fromiter((x for e in self.tokenizer.encode_batch_fast([b" ".join([new[k] for k in some[j : j + 20]]).decode() for j in range(0, len(some), 20)], add_special_tokens=False) for x in e.ids), np.int64)
            stop = np.flatnonzero(self.ends_word[flat]) + 1
            if len(stop) != len(some):
                raise ValueError("the vocabulary doesn't end each word with one end-of-word id")
            size[some] = np.diff(np.r_[0, stop])
            for k, a, b in zip(some, np.r_[0, stop[:-1]].tolist(), stop.tolist(), strict=True):
                got[k] = flat[a:b]
        rest = [k for k, yes in enumerate(alone) if not yes]
        for i in range(0, len(rest), 20_000):
            some = rest[i : i + 20_000]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([new[k].decode("utf-8", "replace") for k in some], add_special_tokens=False), strict=True):
                got[k] = np.array(e.ids, np.int64)
                size[k] = len(got[k])
        if new:
            self.part_ids.append(np.concatenate(got), size)

    def _add_words(self) -> None:
        new, self.words.new = self.words.new, []
        parts, at = [], []  # the parts of all words, and each one's place: two for a word, of which the second may be empty
        for i, w in enumerate(new):
            low = w if b"<|" in w else w.lower()  # ASCII only; a special token's name keeps its case
            head = low.rstrip(_MARKS)
            if len(head) == len(low) or not _letters(head):
                parts.append(low)
                at.append(2 * i)
            else:
                parts += (head, low[len(head) :])
                at += (2 * i, 2 * i + 1)
        pairs = np.zeros(2 * len(new), np.int64)
        pairs[at] = self.parts.of(Words(pa.array(parts, pa.large_binary())))
        self._encode_parts()
        ids, after = self.part_ids.take(pairs)
        if new:
            self.word_ids.append(ids, np.diff(np.r_[0, after[1::2]]))
            self.ends = np.r_[self.ends, np.fromiter((w.endswith(_SENTENCE_END) for w in new), bool, len(new))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, end id after each; tokens of each text; positions after the words that end a sentence."""
        if len(self.words) > REMEMBER:
            self.reset()
        found = Words(texts)
        try:
            words = np.insert(self.words.of(found), found.first[1:], 0)
            self._add_words()
        except BaseException:  # words may be noted without ids, and a later task could get this pool
            self.reset()
            raise
        ids, after = self.word_ids.take(words)
        docs_end = after[words == 0]
        return ids, np.diff(np.r_[0, docs_end]), after[self.ends[words]]


def pool_of(tokenizer_file: str, end_id: int) -> IdPool:
    """The pool that a worker keeps from task to task, so that it encodes a word once and not once a partition."""
    return held_by_worker((IdPool, tokenizer_file, end_id), lambda: IdPool(tokenizer_file, end_id))


def cuts(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, width: int) -> list[int]:
    """Where the sequences of a stream of n tokens end, at least cost; each has at most width tokens.

    A sequence of t tokens costs width - t for padding, or nothing if t is a
    power of two, besides the penalty for the kind of place where it ends.
    """
    gap = min(GAP, width)
    firm = np.unique(np.r_[0, doc_ends, sentence_ends[sentence_ends < n], n])
    wide = np.flatnonzero(np.diff(firm) > gap)
    extra = [np.arange(firm[i] + gap, firm[i + 1], gap) for i in wide]
    # the last sequence may be cut into powers of two
    tail = [n - (k := 1 << b) for b in range(width.bit_length()) if (1 << b) <= min(n, width)]
    at = np.unique(np.concatenate([firm, *extra, np.array(tail, dtype=np.int64)])).astype(np.int64)
    penalty = np.full(len(at), SEQUENCE + HARD_CUT)
    penalty[np.isin(at, sentence_ends)] = SEQUENCE + SENTENCE_CUT
    penalty[np.isin(at, np.r_[doc_ends, n])] = SEQUENCE
    exact: dict[int, list[int]] = {}  # places a power of two before one of the last, where that can save padding
    late = np.flatnonzero(at > n - width)
    for b in range(width.bit_length()):
        back = np.searchsorted(at, at[late] - (1 << b))
        for j, i in zip(late.tolist(), back.tolist(), strict=True):
            if at[i] == at[j] - (1 << b) and 1 << b <= width:
                exact.setdefault(j, []).append(i)
    places, penalties = at.tolist(), penalty.tolist()
    best, came = [0] * len(places), [0] * len(places)
    queue: deque[int] = deque([0])  # ascending in best + place
    for j in range(1, len(places)):
        here = places[j]
        while queue and places[queue[0]] < here - width:
            queue.popleft()
        i = queue[0]
        low, frm = best[i] + width - (here - places[i]), i
        for i in exact.get(j, ()):
            if best[i] <= low:
                low, frm = best[i], i
        best[j], came[j] = low + penalties[j], frm
        key = best[j] + here
        while queue and best[queue[-1]] + places[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    ends, j = [], len(places) - 1
    while j:
        ends.append(places[j])
        j = came[j]
    return ends[::-1]


def _pieces(ids: np.ndarray, doc_ids: list, sizes: np.ndarray, sentence_ends: np.ndarray, width: int, first: int) -> tuple[dict, int]:
    """Rows of one block, and the number of its sequences."""
    doc_ends = np.cumsum(sizes)
    ends = np.array(cuts(len(ids), doc_ends, sentence_ends, width), dtype=np.int64)
    stops = np.union1d(doc_ends, ends)
    starts = np.r_[0, stops[:-1]]
    doc = np.searchsorted(doc_ends, starts, side="right")
    seq = np.searchsorted(ends, starts, side="right")
    raw, seq_start = memoryview(ids.tobytes()), np.r_[0, ends[:-1]]
    return {
        "doc_id": [doc_ids[i] for i in doc],
        "start": starts - (doc_ends - sizes)[doc],
        "length": stops - starts,
        "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)],
        "doc_tokens": sizes[doc],
        "sequence_id": first + seq,
        "offset": starts - seq_start[seq],
    }, len(ends)


def pack(docs: DataFrame, tokenizer_file: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 4096) -> DataFrame:
    """Pack all rows into sequences of at most ``width`` tokens; one row for each piece of a document.

    Returns doc_id, start (the document's ids before the piece), length,
    ids_crc32 (of the piece's ids as little-endian unsigned 32-bit numbers),
    doc_tokens, sequence_id, offset (of the piece in its sequence).

    * Null and empty texts are documents of the end id alone.
    * Repeated rows are documents of their own, with the same doc_id.
    * Documents keep the order of the input's rows within a partition.
    * Extra columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pool_of(tokenizer_file, end_id)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        held: list[tuple] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, tokens, number
            shift = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
            rows, n = _pieces(
                np.concatenate([h[0] for h in held]), [x for h in held for x in h[1]], np.concatenate([h[2] for h in held]),
                np.concatenate([h[3] + s for h, s in zip(held, shift, strict=True)]), width, number,
            )
            held, tokens, number = [], 0, number + n
            return pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], id_type), *(pa.array(rows[k], pa.int64()) for k in list(rows)[1:])], names=list(rows))

        for batch in batches:
            id_type = batch.column(0).type
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids, sizes, ends = pool.encode(part.column(1))
                held.append((ids, part.column(0).to_pylist(), sizes, ends))
                tokens += len(ids)
                if tokens >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA.format(id=kind.simpleString()))
