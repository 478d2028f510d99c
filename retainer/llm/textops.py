"""Vectorised byte-level text helpers for tasks (numpy over Arrow buffers).

All functions work on one flat byte buffer per chunk of documents, so the cost per
byte is that of a few numpy passes and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        step = np.full(size, _BASE, np.uint64)
        step[0] = 1
        _POW = np.multiply.accumulate(step)
        step[1:] = _INV
        _IPOW = np.multiply.accumulate(step)
    return _POW, _IPOW


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows of about `limit` bytes; null is empty text.

    A row is never cut: a longer text makes a chunk of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes that are no ASCII white space."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = np.empty(len(data) + 1, bool)
    inside[:-1] = ~IS_SPACE[data]
    inside[-1] = False
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    return start, end, np.searchsorted(offsets, start, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums for `span_hash`."""
    power, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


class TokenStore:
    """Token ids of words seen lately, so each distinct word is encoded once per worker.

    `encode` turns a list of words (bytes) into a list of id sequences.  The store is
    emptied when it holds more than `limit` words; that changes cost, never results.
    """

    def __init__(self, encode, limit: int = 500_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, words: list[bytes]) -> None:
        for word, ids in zip(words, self.encode(words), strict=True):
            n, at = len(ids), len(self.place)
            if self.used + n > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(n, len(self.ids)), np.uint32)])
            if at >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
            self.ids[self.used : self.used + n] = ids
            self.used += n
            self.ends[at] = self.used
            self.place[word] = at

    def gather(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.place) > self.limit:
            self._clear()
        fresh = [w for w in distinct if w not in self.place]
        if fresh:
            self._add(fresh)
        at = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        begin = np.where(at > 0, self.ends[at - 1], 0)
        size = self.ends[at] - begin
        stop = np.cumsum(size)
        total = int(stop[-1])
        return self.ids[np.repeat(begin - (stop - size), size) + np.arange(total)], size


def string_array(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The strings between consecutive byte positions `cuts` of `data`, without copying."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
