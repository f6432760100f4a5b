"""Vectorised text kernels shared by the operators of this folder.

Everything works on flat NumPy arrays over a few megabytes of text at a time, so a task's memory
does not follow the length of its partition. A *word* is a maximal run of ASCII letters and digits
or of any non-ASCII characters of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes.
STEP_BYTES = 2_000_000

_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[128:] = True
for _range in (b"09", b"AZ", b"az"):
    _WORD_BYTE[_range[0] : _range[1] + 1] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijection of uint64 that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW: list[np.ndarray] = [_powers(_ODD, 1 << 16), _powers(_INV, 1 << 16)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        _POW[:] = [_powers(_ODD, size), _powers(_INV, size)]
    return _POW


def span_hashes(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each span of codes: its polynomial as a difference of prefix sums, shifted to position 0
    by an inverse power, so there is no loop over spans."""
    up, down = _grown(len(codes) + 1)
    sums = np.cumsum(codes.astype(np.uint64) * up[: len(codes)], dtype=np.uint64)
    before = np.where(start > 0, sums[start - 1], np.uint64(0))
    return mix64((sums[stop - 1] - before) * down[start] + (stop - start).astype(np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and how many each text has. NULL counts as no words.
    """
    parts = [b"" if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    if not len(parts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _WORD_BYTE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[0::2], edge[1::2]
    hashed = span_hashes(data, start, stop)
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)])))
    return hashed, counts


def _mix64_inplace(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ngram_hashes(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words that end at each position; False where the text has fewer before it."""
    out = _mix64_inplace(words + np.uint64(n))
    ok = np.ones(len(words), dtype=bool)
    for back in range(1, n):
        out *= np.uint64(_ODD)
        out[back:] += words[:-back]
        _mix64_inplace(out)
        ok[:back] = False
        ok[back:] &= owner[back:] == owner[:-back]
    return out, ok


def steps(sizes: list[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` bytes; a longer text stands alone."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def text_steps(batch: pa.RecordBatch | pa.Table, column: str, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first row, row after the last, texts) for each step over a batch."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for a, b in steps(sizes, limit):
        yield a, b, texts.slice(a, b - a).to_pylist()


class HashTable:
    """Fixed open-addressing map from uint64 to a row number, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(len(keys) * 4).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, dtype=np.uint64)
        self.rows = np.full(size, -1, dtype=np.int32)
        self.shift = np.uint64(64 - (size - 1).bit_length())
        slot = (keys * np.uint64(_ODD)) >> self.shift
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.rows[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]] = keys[won]
            self.rows[slot[won]] = won
            lost = np.ones(len(keys), dtype=bool)
            lost[won] = False
            left = left[lost[left]]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where it is absent."""
        slot = (keys * np.uint64(_ODD)) >> self.shift
        out = self.rows[slot]
        left = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        for _ in range(1, self.probes):
            if not len(left):
                return out
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            row = self.rows[slot[left]]
            out[left] = row
            left = left[(self.keys[slot[left]] != keys[left]) & (row >= 0)]
        out[left] = -1
        return out
