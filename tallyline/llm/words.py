"""Words of Arrow text columns as numpy arrays: positions, hashes and windows, without a Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D. Texts are read as the UTF-8 bytes Arrow already
holds; a NULL text has no words. Texts are handled in blocks of BLOCK bytes (a longer text is a block of its own), so
memory follows the block and not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_POWERS = 1 << 18
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Byte tables for Hasher: as they are, and with A-Z in lower case.
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[ends[0]: ends[-1]], ends.astype(np.int64) - int(ends[0])


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of at most `limit` bytes, or of one row."""
    data, offsets = utf8(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of `counts`, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


class Hasher:
    """Hashes of byte spans: a polynomial over random byte values modulo 2^64, then mixed. Equal bytes, equal hash."""

    def __init__(self, table: np.ndarray = AS_IS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64)[table]
        self.base = int(rng.integers(1, 2**60)) * 8 + 5
        inverse = pow(self.base, -1, 2**64)
        self.up, self.down = self._powers(self.base), self._powers(inverse)

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(_POWERS, np.uint64(base))
        out[0] = 1
        return np.multiply.accumulate(out)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            low = int(starts[at])
            to = int(np.searchsorted(ends, low + _POWERS - 1, "right"))
            if to <= at:  # a word longer than the table of powers
                out[at] = self._long(data[low: int(ends[at])])
                at += 1
                continue
            high = int(ends[to - 1])
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.values[data[low:high]] * self.up[: high - low], out=sums[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = (sums[e] - sums[s]) * self.down[s]
            at = to
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _long(self, word: np.ndarray) -> int:
        total = 0
        for k in range(0, len(word), _POWERS):
            part = self.values[word[k: k + _POWERS]]
            total += int((part * self.up[: len(part)]).sum(dtype=np.uint64)) * pow(self.base, k, 2**64)
        return total % 2**64


class Words:
    """The words of a block: byte spans `starts`/`ends`, and `first`, the word index at which each text begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~_SEP[data]
        edge = inside.copy()
        if len(data):
            before = np.zeros(len(data), bool)
            before[1:] = inside[:-1]
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
            edge &= ~before
        self.starts = np.flatnonzero(edge)
        edge = inside
        if len(data):
            after = np.zeros(len(data), bool)
            after[:-1] = inside[1:]
            after[offsets[1:][offsets[1:] > 0] - 1] = False
            edge = inside & ~after
        self.ends = np.flatnonzero(edge) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, hasher: Hasher) -> np.ndarray:
        return hasher.spans(self.data, self.starts, self.ends)

    def owners(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, first word) of every window of `size` words of one text."""
        n = np.maximum(self.counts - size + 1, 0)
        return np.repeat(np.arange(len(n)), n), np.repeat(self.first[:-1], n) + ragged(n)


def window_hashes(words: np.ndarray, size: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """The hash of `size` words from each position on, by doubling; the last size - 1 positions have none."""
    factor = seed | 5

    def grow(n: int) -> np.ndarray:
        if n == 1:
            return words
        half = grow(n // 2)
        got = half[: len(half) - n // 2] * np.uint64(pow(factor, n // 2, 2**64)) + half[n // 2:]
        if n % 2:
            got = got[: len(got) - 1] * np.uint64(factor) + words[n - 1:]
        return got

    return mix(grow(size)) if len(words) >= size else np.zeros(0, np.uint64)
