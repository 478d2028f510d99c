"""Bounded-space online packing of tokenised documents (operator 8).

Each partition keeps a fixed number of open windows of `size` tokens.  Whole windows of
a long document go out at once; the rest is placed best-fit.  If none fits and no more
windows may open, the fullest is topped up with the document's head and emitted, and the
tail is placed in turn.  Windows still open when a partition ends are merged by rounds of
best-fit over bounded batches, until one batch holds what is left.

A worker tokenises each distinct word once (`textops.TokenStore`): the tokenizer never
joins text across ASCII white space, so words are independent.  Nor does it join an ASCII letter or digit to the punctuation
after it, and it lower-cases text: a word's last run of punctuation is a word of its own, and ASCII capitals are
lowered before words are looked up (`parted`), which leaves about a third fewer words to encode.

Nulls: a null text is empty and packs as the end id alone; a null doc_id is carried.  Repeated
rows are packed as often as they occur.  An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainer.llm.textops import LOWER, TokenStore, chunks, string_array, word_spans
from retainer.llm.workspace import materialize, only

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("window", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


class Windows:
    """Open windows ordered by free space."""

    def __init__(self, size: int, most_open: int, first_id: int):
        self.size, self.most_open, self.next_id = size, most_open, first_id
        self.free: list[tuple[int, int]] = []

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def best_fit(self, length: int) -> tuple[int, int] | None:
        """(window, offset) of the fullest window with room for `length`, or of a new one; None if neither."""
        at = bisect.bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        elif len(self.free) < self.most_open:
            room, window = self.size, self.new()
        else:
            return None
        if room > length:
            bisect.insort(self.free, (room - length, window))
        return window, self.size - room

    def emit_fullest(self) -> tuple[int, int]:
        """(room, window) of the fullest window, which is closed."""
        return self.free.pop(0)


def place(length: int, windows: Windows) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, window, offset) of the pieces of a document of `length` tokens."""
    start = 0
    while length - start >= windows.size:
        yield start, windows.size, windows.new(), 0
        start += windows.size
    while start < length:
        if found := windows.best_fit(length - start):
            yield start, length - start, *found
            return
        room, window = windows.emit_fullest()
        yield start, room, window, windows.size - room
        start += room


#: Words that are encoded in one call.
CALL = 256


def word_tokenizer(path: str):
    """Encoder of lists of words for `FlatStore`.

    Many words go through the tokenizer as one text, with a mark of one id between blanks after each.  A blank ends a word for
    the tokenizer, and a number sign stands alone, so a word's ids are those before its mark.  A word that itself
    holds the mark is encoded alone.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    mark, mark_id = next((c, ids[0]) for c in "¾½¼²³" if len(ids := tokenizer.encode(c, add_special_tokens=False).ids) == 1)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        sizes, parts, own = np.zeros(len(words), np.int64), [], {}
        for i in [i for i, x in enumerate(texts) if mark in x]:
            own[i], texts[i] = tokenizer.encode(texts[i], add_special_tokens=False).ids, ""
        groups = [f" {mark} ".join([*texts[i : i + CALL], ""]) for i in range(0, len(texts), CALL)]
        for k, e in enumerate(tokenizer.encode_batch_fast(groups, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(ids == mark_id)
            first = k * CALL
            sizes[first : first + len(marks)] = np.diff(marks, prepend=-1) - 1
            parts.append(np.delete(ids, marks))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if own:
            ends = np.cumsum(sizes)
            flat = np.insert(flat, np.repeat([ends[i] for i in own], [len(x) for x in own.values()]), np.concatenate([np.array(x, np.uint32) for x in own.values()]))
            sizes[list(own)] = [len(x) for x in own.values()]
        return flat, sizes

    return encode


class FlatStore(TokenStore):
    """A store whose `encode` gives (ids of all words, number of ids of each)."""

    def _add(self, words: list[bytes]) -> None:
        ids, sizes = self.encode(words)
        n, at = len(ids), len(self.place)
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(n, len(self.ids)), np.uint32)])
        if at + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(words), len(self.ends)), np.int64)])
        self.ids[self.used : self.used + n] = ids
        self.ends[at : at + len(words)] = self.used + np.cumsum(sizes)
        self.used += n
        self.place.update(zip(words, range(at, at + len(words))))


_STORES: dict[str, FlatStore] = {}


def _store(path: str) -> FlatStore:
    if path not in _STORES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _STORES[path] = FlatStore(word_tokenizer(path))
    return _STORES[path]


_CODES = np.arange(256)
_ALNUM = np.isin(_CODES, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
_PUNCT = (_CODES > 32) & (_CODES < 127) & ~_ALNUM
#: What starts a special token; text that holds it is left as it is.
SPECIAL = b"<|"


def parted(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row) of words that give the same ids: ASCII capitals lowered, unless a byte of another character (a mark that
    may combine with the capital) follows, and punctuation at a word's end apart from the ASCII letter or digit before it."""
    if not len(start) or SPECIAL in data.tobytes().lower():
        return data, start, end, row
    free = np.ones(len(data), bool)
    free[:-1] = data[1:] < 128
    last = np.where(_PUNCT[data], -1, np.arange(len(data)))
    last = np.maximum.accumulate(last)[end - 1]
    cut = np.flatnonzero((last >= start) & (last < end - 1) & _ALNUM[data[np.maximum(last, 0)]])
    data = np.where(free, LOWER[data], data)
    at = last[cut] + 1
    return data, np.insert(start, cut + 1, at), np.insert(end, cut, at), np.insert(row, cut, row[cut])


def document_tokens(column: pa.Array, store: TokenStore, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with the end id) of each text."""
    for first, data, offsets in chunks(column, 4 << 20):
        data, start, end, row = parted(data, *word_spans(data, offsets))
        cuts = np.zeros(2 * len(start) + 1, np.int64)
        cuts[:-1:2], cuts[1::2] = start, end
        cuts[-1] = end[-1] if len(end) else 0
        words = string_array(data, cuts).take(pa.array(np.arange(0, 2 * len(start), 2))) if len(start) else pa.array([], pa.large_binary())
        ids, size = store.gather(words)
        stops = np.concatenate([[0], np.cumsum(size)])
        bounds = stops[np.searchsorted(row, np.arange(len(offsets)))]
        for i in range(len(offsets) - 1):
            yield first + i, np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id))


def _pack_partition(path: str, size: int, most_open: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(path)
        windows = Windows(size, most_open, TaskContext.get().partitionId() << 40)
        for batch in batches:
            doc_ids, rows = batch.column(0).to_pylist(), []
            for i, ids in document_tokens(batch.column(1), store, end_id):
                raw = memoryview(ids.astype("<u4").tobytes())
                rows += [(doc_ids[i], start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), len(ids), window, offset, False)
                         for start, n, window, offset in place(len(ids), windows)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)
        rest = [(None, None, size - room, None, None, window, None, True) for room, window in windows.free]
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return run, ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, `offset` long, `open` boolean")


def _merge_batch(size: int, most_open: int, last: bool):
    """Best-fit of open windows into new ones, longest first; (window, target, shift) and what stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sorted(((n, w) for b in batches for n, w in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True)), reverse=True)
        windows, target, rows = Windows(size, len(items) if last else most_open, 0), {}, []
        for n, w in items:
            while (found := windows.best_fit(n)) is None:
                windows.emit_fullest()
            rows.append((w, target.setdefault(found[0], w), found[1]))
        still = {target[w]: size - room for room, w in windows.free}
        if rows:
            cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [still.get(r[1]) if r[0] == r[1] else None for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["window", "target", "shift", "still"])

    return run, "window long, target long, shift long, still long"


def pack(docs: DataFrame, path: str | None = None, size: int = 2048, most_open: int = 16, end_id: int = 1,
         merge_rows: int = 4096) -> DataFrame:
    """Pieces of the documents (doc_id, text) in windows of `size` ids; see the module text.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    if merge_rows < 4 * most_open:
        raise ValueError("merge_rows must be at least four times most_open, so that every round leaves fewer windows")
    path = path or public_tokenizers.path("word_bpe_49k.json")
    source = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    run, schema = _pack_partition(path, size, most_open, end_id)
    packed = materialize(source.mapInArrow(run, schema), "pack-pieces")
    moved = None
    left = packed.filter("open").select("window", "length")
    count = left.count()
    while count > 1:
        last = count <= merge_rows
        run, schema = _merge_batch(size, most_open, last)
        parts = left.repartition(1) if last else left.repartition(-(-count // merge_rows), F.hash("window"))
        step = materialize(parts.mapInArrow(run, schema), "pack-merge")
        hop = step.select("window", "target", "shift")
        if moved is None:
            moved = hop
        else:
            nxt = hop.select(F.col("window").alias("target"), F.col("target").alias("t2"), F.col("shift").alias("s2"))
            moved = materialize(moved.join(nxt, "target", "left").select(
                "window", F.coalesce("t2", "target").alias("target"), (F.col("shift") + F.coalesce("s2", F.lit(0))).alias("shift")), "pack-moved")
        if last:
            break
        left = step.filter("still is not null").select("window", F.col("still").alias("length"))
        count = left.count()
    pieces = packed.filter("not open").drop("open")
    if moved is None:
        return pieces.withColumnRenamed("window", "sequence_id").select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return pieces.join(moved, "window", "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("target", "window").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
