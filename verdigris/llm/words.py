"""The words of many texts at once, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from verdigris.llm.shingles import mix

#: Bytes of texts about that are taken at once, so that their arrays stay in a core's cache.
CHUNK = 1 << 20
#: Longer words are hashed one by one.
LONG = 64
_SIZE = np.uint64(0x9E3779B97F4A7C15)
#: The first bytes of eight, by number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words:
    """Words of texts, split at ASCII white space; null texts have none.

    ``start`` and ``stop`` are places in ``data``, the bytes of all texts;
    ``text`` is each word's text, and ``first`` where each text's words begin,
    with their number at the end.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, at, raw = texts.buffers()
        at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        solid = (self.data != 32) & (self.data - np.uint8(9) > 4)
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        edge = at[(at > 0) & (at < len(solid))]  # texts follow each other without a break
        begins[edge], ends[edge - 1] = solid[edge], solid[edge - 1]
        self.start, self.stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def _eights(self) -> np.ndarray:
        """The eight bytes from each place on, as a number."""
        padded = np.r_[self.data, np.zeros(8, np.uint8)]
        return np.ndarray(len(self.data), "<u8", padded.data, strides=(1,))

    def heads(self) -> np.ndarray:
        """The first bytes of each word, up to eight, as a number."""
        return self._eights()[self.start] & _FIRST[np.minimum(self.stop - self.start, 8)]

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, eight bytes at a time; no two words of up to eight bytes and one length agree."""
        size = self.stop - self.start
        eight = self._eights()
        out = size.astype(np.uint64) * _SIZE
        rows: np.ndarray | slice = slice(None)
        for k in range(0, LONG, 8):
            if k:
                rows = np.flatnonzero((size > k) & (size <= LONG))
                if not len(rows):
                    break
            out[rows] = mix(out[rows] ^ (eight[self.start[rows] + k] & _FIRST[np.minimum(size[rows] - k, 8)]))
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.stop[i]].tobytes())
        return out

    def joined(self, stay: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """How many words stay of each text, and these joined by one space."""
        kept = np.flatnonzero(stay)
        number = np.searchsorted(kept, self.first)
        start, stop, text = self.start[kept], self.stop[kept], self.text[kept]
        more = np.flatnonzero(text[1:] == text[:-1])  # the byte after such a word is white space of its text
        data = self.data.copy()
        data[stop[more]] = 32
        stop[more] += 1
        edge = np.zeros(len(data) + 1, np.int8)
        edge[start] += 1
        edge[stop] -= 1
        at = np.r_[0, np.cumsum(stop - start)][number].astype(np.int32)
        data = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
        return np.diff(number), pa.Array.from_buffers(pa.string(), len(number) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])


def chunks(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """Words of some texts after the other, with the first one's row; a text is never cut."""
    sizes = texts.cast(pa.binary()).fill_null(b"")
    at = np.frombuffer(sizes.buffers()[1], np.int32)[sizes.offset : sizes.offset + len(sizes) + 1].astype(np.int64) if len(sizes) else np.zeros(1, np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        yield i, Words(texts.slice(i, j - i))
        i = j
