"""Vectorised word work on Arrow text batches: one numpy pass over the bytes of many texts.

A word is a run of bytes other than white space ``[\\x20\\x09-\\x0D]``.  Words get
64-bit hashes; the hash of a word depends on its bytes only, never on the batch.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # of text at a time: working arrays take about 30 bytes for each
LONG_WORD = 512  # bytes from which a word is hashed by BLAKE2, where a polynomial hash is weak
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
ODD = mix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_MULTIPLIER, n), _powers(pow(_MULTIPLIER, -1, 1 << 64), n)


@dataclass
class Words:
    """The words of some texts: data[start:end] is a word, doc its text, first[d]:first[d + 1] the words of text d."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        n = max(1, 1 << int(len(self.data)).bit_length())
        power, inverse = _power_tables(max(n, 2 * CHUNK_BYTES))
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_HASH[self.data] * power[: len(self.data)], out=sums[1:])
        size = (self.end - self.start).astype(np.uint64)
        out = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + size * np.uint64(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(size >= LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the n + 1 bounds of its texts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> Words:
    """Split texts into words; lower folds A-Z only."""
    if lower:
        data = LOWER[data]
    n = len(bounds) - 1
    solid = ~IS_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    if len(data):
        inner = bounds[:-1][bounds[:-1] < len(data)]
        begins[inner] = solid[inner]
        last = bounds[1:][bounds[1:] > 0] - 1
        ends[last] = solid[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, bounds)
    return Words(data, bounds, start, end, np.repeat(np.arange(n), np.diff(first)), first)


def trim() -> None:
    """Give freed memory back: reused workers would keep the most that any operator before took."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most limit bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        trim()


def shingles(w: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and the text of each, in order; a text of 1 to k - 1 words gives all of them as one."""
    n = np.diff(w.first)
    if len(h) >= k:
        whole = w.doc[: len(h) - k + 1] == w.doc[k - 1 :]
        acc = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for j in range(k):
            acc += h[j : len(h) - k + 1 + j] * ODD[j]
        long_hash, long_doc = mix(acc[whole]), w.doc[: len(h) - k + 1][whole]
    else:
        long_hash, long_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < k))
    if not len(few):
        return long_hash, long_doc
    acc = np.zeros(len(few), dtype=np.uint64)
    for j in range(k - 1):
        has = n[few] > j
        acc[has] += h[w.first[:-1][few[has]] + j] * ODD[32 + j]
    hashed, doc = np.concatenate([long_hash, mix(acc + n[few].astype(np.uint64))]), np.concatenate([long_doc, few])
    order = np.argsort(doc, kind="stable")
    return hashed[order], doc[order]
