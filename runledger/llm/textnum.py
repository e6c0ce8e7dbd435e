"""Numpy kernels over the UTF-8 bytes of an Arrow string column: words, word hashes, shingles.

Both word classes are unions of whole UTF-8 sequences (every byte of a non-ASCII code point
is a word byte), so scanning bytes gives the same words as scanning code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time, unless one text is longer.
CHUNK = 2_000_000


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _splitmix
_BYTE = _splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ROLL = _splitmix(np.arange(301, 365, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bytes(kind: str) -> np.ndarray:
    """Which bytes belong to words: 'space' splits at white space, 'alnum' at ASCII non-alphanumerics (lower-cased)."""
    t = np.ones(256, bool)
    if kind == "space":
        t[[32, 9, 10, 11, 12, 13]] = False
    else:
        t[:48] = t[58:97] = t[123:128] = False
    return t


@dataclass
class Words:
    """Words of the texts first..first+n: text i has words off[i]..off[i+1]."""

    first: int
    data: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray | None
    begin: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> str:
        return self.data[self.begin[i] : self.begin[i + 1]].tobytes().decode("utf-8", "replace")

    def word(self, k: int) -> str:
        return self.data[self.start[k] : self.end[k]].tobytes().decode("utf-8", "replace")


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def words(column: pa.Array, kind: str, hashes: bool = True) -> Iterator[Words]:
    """The lower-cased (A-Z) words of a column, in runs of whole texts of about CHUNK bytes."""
    data, off = texts(column)
    is_word, i, n = word_bytes(kind), 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
        begin = off[i : j + 1] - off[i]
        d = _LOWER[data[off[i] : off[j]]]
        m = is_word[d]
        edge = np.zeros(len(d) + 1, bool)
        edge[begin] = True
        before = np.empty(len(d), bool)
        before[:1], before[1:] = False, m[:-1]
        start = np.flatnonzero(m & (~before | edge[:-1]))
        after = np.empty(len(d), bool)
        after[-1:], after[:-1] = False, m[1:]
        end = np.flatnonzero(m & (~after | edge[1:])) + 1
        h = None
        if hashes:
            size = end - start
            at = np.cumsum(size) - size
            place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(at, size)
            power = np.ones(int(size.max(initial=0)) + 1, np.uint64)
            if len(power) > 1:
                power[1:] = np.cumprod(np.full(len(power) - 1, _STEP, np.uint64))
            h = mix(np.add.reduceat(_BYTE[d[m]] * power[place], at) + size.astype(np.uint64)) if len(size) else np.zeros(0, np.uint64)
        yield Words(i, d, np.searchsorted(start, begin), start, end, h, begin)
        i = j


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (also across texts: the caller cuts those)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    s = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        s += h[j : j + len(s)] * _ROLL[j % 64]
    return mix(s)


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its k-word shingles; of fewer words, the
    whole sequence is one; of none, empty."""
    full = roll(w.hash, k)
    for i in range(w.n):
        a, b = int(w.off[i]), int(w.off[i + 1])
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            yield roll(w.hash[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array for each row."""
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, kind))
