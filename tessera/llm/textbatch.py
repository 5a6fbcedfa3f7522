"""Vectorised views of Arrow text columns: words, hashes and windows.

A ``TextSlice`` wraps a few megabytes of texts as one byte buffer.  Words are
the runs ``[^\\x20\\x09-\\x0D]+``.  A word's 64-bit hash mixes its bytes eight at
a time, that of a run of words mixes those of its halves; neither is a
polynomial, whose collisions could be written down (Thue-Morse words).  There is
no Python loop over words but for those over ``LONG_WORD`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64 arrays."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


LONG_WORD = 256
_LENGTH, _NEXT = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of one run of words followed by another."""
    return mix(a * _NEXT + b)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``data[start:end]`` for each pair; none is empty."""
    if not len(start):
        return np.zeros(0, _U)
    size, padded = end - start, np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", buffer=padded, strides=(1,))  # the eight bytes from every place on
    out = mix((eight[start] & _MASK[np.minimum(size, 8)]) + size.astype(_U) * _LENGTH)
    left, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(left):
        out[left] = join_hash(out[left], eight[start[left] + at] & _MASK[np.minimum(size[left] - at, 8)])
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


class TextSlice:
    """A few texts side by side; nulls count as empty texts."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.texts = texts
        self.n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        first = int(at[0])
        self.offsets = at - first
        size = int(self.offsets[-1])
        self.data = np.frombuffer(data, np.uint8)[first : first + size] if size else np.zeros(0, np.uint8)

    def keep(self, rows: np.ndarray) -> TextSlice:
        return TextSlice(self.texts.filter(pa.array(rows)))

    def text(self, i: int) -> str:
        return self.texts[i].as_py()

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags of the bytes of each text."""
        if np.count_nonzero(flags) * 4 < len(flags):
            return np.diff(np.searchsorted(np.flatnonzero(flags), self.offsets))
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    @cached_property
    def _inside(self) -> np.ndarray:
        return ~_SPACE[self.data]

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        inside, cut = self._inside, self.offsets[:-1][self.sizes > 0]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[cut] = inside[cut]
        ends[:-1] &= ~inside[1:]
        last = self.offsets[1:][self.sizes > 0] - 1
        ends[last] = inside[last]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._edges[0]

    @property
    def ends(self) -> np.ndarray:
        return self._edges[1]

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    @cached_property
    def word_text(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.per_text(self._inside & ((self.data & 0xC0) != 0x80))

    @cached_property
    def word_hash(self) -> np.ndarray:
        return hash_ranges(self.data, self.starts, self.ends)

    @cached_property
    def _runs(self) -> dict[int, np.ndarray]:
        return {1: self.word_hash}

    def run_hash(self, k: int) -> np.ndarray:
        """Hash of the k words from every word on that k - 1 others follow,
        whatever text they are in."""
        if k not in self._runs:
            half = 1 << (k - 1).bit_length() - 1
            n = max(0, len(self.starts) - k + 1)
            self._runs[k] = join_hash(self.run_hash(half)[:n], self.run_hash(k - half)[half : half + n])
        return self._runs[k]

    def window_starts(self, k: int) -> np.ndarray:
        """Words at which a window of k words of one text starts."""
        left = np.repeat(self.word_offsets[1:], self.n_words) - np.arange(len(self.starts))
        return np.flatnonzero(left >= k)

    def window_hash(self, at: np.ndarray, k: int) -> np.ndarray:
        return self.run_hash(k)[at]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, TextSlice]]:
    """The batch in runs of rows with about ``most`` bytes of text each; a
    longer text makes a run of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin, total = np.cumsum(sizes), 0, 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, total + most, side="right")))
        part = batch.slice(begin, end - begin)
        yield part, TextSlice(part.column(batch.schema.get_field_index(text)))
        total, begin = int(ends[end - 1]), end


def grams(s: TextSlice, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (n up to 8) of bytes at every place of ``data``, packed into
    integers, and which of them lie within one text."""
    count = max(0, len(data) - n + 1)
    packed = np.zeros(count, np.uint64 if n > 4 else np.uint32)
    for j in range(n):
        packed <<= packed.dtype.type(8)
        packed |= data[j : j + count]
    whole = np.ones(count, bool)
    for k in range(1, n):
        cut = s.offsets[1:] - k
        whole[cut[(cut >= 0) & (cut < count)]] = False
    return packed, whole
