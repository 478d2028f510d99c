"""Removal of byte strings that repeat from earlier documents, by difference-cover suffix sorting (operator 4).

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
doc_id.  Sorting every suffix of the corpus would move many times its size, so the sort runs on what
can match at all:

1. Content-defined sample: of every window of `length` bytes the k-gram of smallest hash is its anchor.
   Equal windows have equal anchors at equal places (the property a difference cover gives to any two
   suffixes), so only windows whose anchor occurs in two documents can match.  Consecutive windows with
   one anchor form a run; anchors are exchanged as packed 32-bit hashes.
2. Runs with such anchors are dealt by anchor, distinct strings once per group of documents.  An anchor
   with more than `hot_runs` different runs is hot: its windows are dealt singly, by their own hash.
3. Per deal, in batches of whole anchors, the distinct runs are concatenated and suffix-sorted by the difference-cover algorithm (sort
   the triples at positions 1 and 2 mod 3, recurse on their names until names span `length` bytes, place
   the remaining suffixes by their first symbol and the rank that follows, merge).  Neighbours in the order
   whose first `length` bytes agree form classes; a class's smallest doc_id decides.
4. Each document group gets one bit per window back and cuts its texts.

The text is dealt by a hash of doc_id; groups hold about `group_bytes`.  Texts are whole.

Nulls: a null text is empty; a row with null doc_id matches nothing and is left as it is.  Rows with the
same doc_id never remove each other's bytes.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retainer.llm.textops import chunks, mix, powers, prefix_hash, span_hash

GRAM = 20
_PLACE = np.uint64((1 << 24) - 1)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Runs:
    """Runs of consecutive windows with one anchor, in a chunk."""

    start: np.ndarray  # first window
    count: np.ndarray  # number of windows
    anchor: np.ndarray  # hash of the anchor
    row: np.ndarray


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> Runs:
    """All runs of the texts of a chunk; windows lie within one text."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return Runs(none, none, np.zeros(0, np.uint64), none)
    if len(data) > int(_PLACE):
        return _long_runs(data, offsets, length)
    prefix = prefix_hash(data)
    n = len(data) - GRAM + 1
    _, inverse = powers(len(prefix))
    value = prefix[GRAM:] - prefix[:n]
    value *= inverse[:n]
    value *= _SPREAD
    value &= ~_PLACE
    value |= np.arange(n, dtype=np.uint64)
    span, have = length - GRAM + 1, 1
    while 2 * have <= span:
        value = np.minimum(value[:-have], value[have:])
        have *= 2
    if have < span:
        value = np.minimum(value[: len(value) - (span - have)], value[span - have :])
    place = (value & _PLACE).astype(np.int32)
    valid = np.ones(len(place), bool)
    turn = np.zeros(len(place), bool)
    turn[0] = True
    turn[1:] = place[1:] != place[:-1]
    for cut in offsets[1:-1]:
        valid[max(0, cut - length + 1) : cut] = False
        if cut < len(turn):
            turn[cut] = True
    turn[1:] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(turn)
    count = np.diff(np.append(first, len(place)))
    good = valid[first]
    first, count = first[good], count[good]
    at = place[first].astype(np.int64)
    return Runs(first, count, span_hash(prefix, at, at + GRAM), np.searchsorted(offsets, first, "right") - 1)


def _long_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> Runs:
    """`runs_of` for a text that is longer than a place number: pieces that overlap by a window less one byte."""
    step, parts = int(_PLACE) - length, []
    for a in range(0, max(1, len(data) - length + 1), step):
        part = data[a : a + step + length - 1]
        r = runs_of(part, np.array([0, len(part)]), length)
        parts.append((r.start + a, r.count, r.anchor))
    start, count, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(offsets) != 2:
        raise ValueError("a chunk this long holds one text")
    return Runs(start, count, anchor, np.zeros(len(start), np.int64))


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of `symbols` (each 1 or more) in an order that is right for 3**depth symbols at least."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    top = int(symbols.max()) + 1
    s = np.concatenate([symbols, np.zeros(4, np.int64)]).astype(np.int64)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    if top**3 < 2**62:
        key = (s[sampled] * top + s[sampled + 1]) * top + s[sampled + 2]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])
    else:
        order = np.lexsort((s[sampled + 2], s[sampled + 1], s[sampled]))
        at = sampled[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (s[at[1:]] != s[at[:-1]]) | (s[at[1:] + 1] != s[at[:-1] + 1]) | (s[at[1:] + 2] != s[at[:-1] + 2])
    name = np.cumsum(fresh)
    names = np.empty(len(sampled), np.int64)
    names[order] = name
    if name[-1] < len(sampled) and depth > 1:
        order = suffix_order(names, depth - 1)
        names[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = names
    placed = sampled[order]
    placed = placed[placed < n]
    zero = np.arange(0, n, 3)
    wide = len(sampled) + 2
    zero_key = s[zero] * wide + rank[zero + 1]
    turn = np.argsort(zero_key, kind="stable")
    zero, zero_key = zero[turn], zero_key[turn]
    one, two = placed[placed % 3 == 1], placed[placed % 3 == 2]
    before = np.searchsorted(s[one] * wide + rank[one + 1], zero_key, "left")
    if top * top * wide < 2**62:
        before += np.searchsorted((s[two] * top + s[two + 1]) * wide + rank[two + 2],
                                  (s[zero] * top + s[zero + 1]) * wide + rank[zero + 2], "left")
    else:  # names of the pairs first, so that the key fits
        pair = s[:-1] * top + s[1:]
        small = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        before += np.searchsorted(small[two] * wide + rank[two + 2], small[zero] * wide + rank[zero + 2], "left")
    # ranks tie beyond the depth, so insertion points may cross within a tie; any order of a tie will do
    slot = np.maximum.accumulate(before) + np.arange(len(zero))
    result = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[slot] = True
    result[slot] = zero
    result[~taken] = placed
    return result


def anchors_of(texts: np.ndarray, ends: np.ndarray, length: int, block: int = 1 << 18) -> np.ndarray:
    """The anchor hash of each run (bytes up to `ends`)."""
    out, a = np.empty(len(ends), np.uint64), 0
    while a < len(ends):
        begin = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, begin + block, "right")))
        out[a:b] = runs_of(texts[begin : ends[b - 1]], np.append(begin, ends[a:b]) - begin, length).anchor
        a = b
    return out


def earliest_in_batches(texts: np.ndarray, ends: np.ndarray, docs: np.ndarray, length: int, batch: int = 1 << 19) -> np.ndarray:
    """`earliest` of any number of runs, sorted in batches of whole anchors of about `batch` bytes."""
    anchors = anchors_of(texts, ends, length)
    order = np.argsort(anchors, kind="stable")
    size = np.diff(ends, prepend=0)
    grown = np.cumsum(size[order])
    bits, a = np.zeros(len(docs), np.uint64), 0
    while a < len(order):
        b = int(np.searchsorted(grown, (grown[a - 1] if a else 0) + batch, "right"))
        b = int(np.searchsorted(anchors[order], anchors[order[min(b, len(order) - 1)]], "left"))
        if b <= a:  # one anchor fills the batch
            b = int(np.searchsorted(anchors[order], anchors[order[a]], "right"))
        elif grown[-1] - (grown[a - 1] if a else 0) <= batch:
            b = len(order)
        part = order[a:b]
        each = size[part]
        stop = np.cumsum(each)
        source = np.repeat(ends[part] - stop, each) + np.arange(int(stop[-1]))
        bits[part] = earliest(texts[source], stop, docs[part], anchors[part], length)
        a = b
    return bits


def earliest(texts: np.ndarray, ends: np.ndarray, docs: np.ndarray, anchors: np.ndarray, length: int) -> np.ndarray:
    """For each run (bytes up to `ends`, its document, its anchor) bits: window j occurs in an earlier document."""
    begin = np.concatenate([[0], ends[:-1]])
    count = ends - begin - length + 1
    identity = _hash_in_blocks(texts, begin, ends) ^ mix(anchors)
    order = np.lexsort((docs, identity))
    fresh = np.append(True, identity[order][1:] != identity[order][:-1])
    which = np.empty(len(docs), np.int64)
    which[order] = np.cumsum(fresh) - 1
    chosen = order[fresh]  # the smallest document of each distinct run
    owner = docs[chosen]
    kinds = np.argsort(anchors[chosen], kind="stable")
    a = anchors[chosen][kinds]
    alone = np.append(True, a[1:] != a[:-1]) & np.append(a[1:] != a[:-1], True)
    first_doc: dict[int, np.ndarray] = {}
    crowd = np.sort(kinds[~alone])
    if len(crowd):
        runs = chosen[crowd]
        size = ends[runs] - begin[runs]
        stop = np.cumsum(size + 1)
        new = stop - size - 1
        text = np.zeros(int(stop[-1]), np.int64)
        inside = np.repeat(new - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        source = np.repeat(begin[runs] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        text[inside] = texts[source]
        text[inside] += 2
        text[stop - 1] = 1
        depth, reach = 1, 3
        while reach < length:
            depth, reach = depth + 1, reach * 3
        suffixes = suffix_order(text, depth)
        run_at = np.repeat(np.arange(len(runs)), size + 1)
        window = np.arange(len(text)) - np.repeat(new, size + 1)
        keep = window[suffixes] < np.repeat(count[runs], size + 1)[suffixes]
        suffixes = suffixes[keep]
        same = np.ones(len(suffixes), bool)
        same[0] = False
        left = np.flatnonzero(same)
        for j in range(length):  # compare neighbouring prefixes
            left = left[text[suffixes[left] + j] == text[suffixes[left - 1] + j]]
        same[:] = False
        same[left] = True
        head = np.flatnonzero(~same)
        least = np.minimum.reduceat(owner[crowd][run_at[suffixes]], head)
        low_at = np.empty(len(text), np.int64)
        low_at[suffixes] = np.repeat(least, np.diff(np.append(head, len(suffixes))))
        first_doc = {int(c): low_at[b : b + n] for c, b, n in zip(crowd, new, count[runs], strict=True)}
    bits = np.zeros(len(docs), np.uint64)
    whole = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
    later = owner[which] < docs
    bits[later] = whole[later]
    for i in np.flatnonzero(~later & np.isin(which, crowd)):
        below = np.flatnonzero(first_doc[int(which[i])] < docs[i])
        if len(below):
            bits[i] = np.bitwise_or.reduce(np.uint64(1) << below.astype(np.uint64))
    return bits


@dataclass
class Sent:
    """What a document group asks about: distinct strings with their smallest document, and who waits for the answer."""

    text: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    part: np.ndarray
    start: np.ndarray  # global window of each waiting run or window
    count: np.ndarray
    row: np.ndarray
    which: np.ndarray  # its string


class Group:
    """The texts of one document group, in a fixed order."""

    def __init__(self, rows: pa.Table, length: int):
        self.length = length
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.rows = rows
        self.ids = rows["doc_id"].to_numpy(zero_copy_only=False)
        parts = [(i, d, o, runs_of(d, o, length)) for i, d, o in chunks(rows["text"], 256 << 10)]
        shift = np.concatenate([[0], np.cumsum([len(d) for _, d, _, _ in parts])]).astype(np.int64)
        self.data = np.concatenate([d for _, d, _, _ in parts]) if parts else np.zeros(0, np.uint8)
        self.offsets = np.concatenate([np.zeros(1, np.int64), *(o[1:] + s for (_, _, o, _), s in zip(parts, shift, strict=False))])
        self.start = np.concatenate([r.start + s for (*_, r), s in zip(parts, shift, strict=False)] or [np.zeros(0, np.int64)])
        self.row = np.concatenate([r.row + i for i, _, _, r in parts] or [np.zeros(0, np.int64)])
        self.count = np.concatenate([r.count for *_, r in parts] or [np.zeros(0, np.int64)])
        self.anchor = np.concatenate([r.anchor for *_, r in parts] or [np.zeros(0, np.uint64)])

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchor hashes, sorted, and for each twice its number of distinct runs here (up to 127), plus one if several documents have it."""
        whole = _hash_in_blocks(self.data, self.start, self.start + self.count + self.length - 1)
        order = np.lexsort((whole, self.anchor))
        a, d, w = self.anchor[order], self.ids[self.row[order]], whole[order]
        if not len(a):
            return a, np.zeros(0, np.uint8)
        fresh = np.append(True, a[1:] != a[:-1])
        head = np.flatnonzero(fresh)
        runs = np.add.reduceat(fresh | np.append(True, w[1:] != w[:-1]), head)
        several = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
        return a[head], (2 * np.minimum(runs, 127) + several).astype(np.uint8)

    def send(self, shared: np.ndarray, hot: np.ndarray, parts: int) -> Sent:
        """Runs whose anchors are `shared`; those of `hot` anchors as single windows."""
        keep = np.isin(self.anchor >> np.uint64(24), shared)
        start, count, row, anchor = self.start[keep], self.count[keep], self.row[keep], self.anchor[keep]
        many = np.isin(anchor >> np.uint64(24), hot)
        each = np.where(many, count, 1)
        inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        start = np.repeat(start, each) + inner
        single = np.repeat(many, each)
        count, row, anchor = np.where(single, 1, np.repeat(count, each)), np.repeat(row, each), np.repeat(anchor, each)
        whole = _hash_in_blocks(self.data, start, start + count + self.length - 1)
        key = np.where(single, whole, anchor)
        order = np.lexsort((self.ids[row], whole))
        fresh = np.append(True, whole[order][1:] != whole[order][:-1]) if len(order) else np.zeros(0, bool)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(fresh) - 1
        chosen = order[fresh]
        part = (mix(key[chosen] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)
        sort = np.lexsort((whole[chosen], part))
        place = np.empty(len(sort), np.int64)
        place[sort] = np.arange(len(sort))
        chosen = chosen[sort]
        size = count[chosen] + self.length - 1
        ends = np.cumsum(size)
        source = np.repeat(start[chosen] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return Sent(self.data[source], ends, self.ids[row[chosen]], part[sort], start, count, row, place[which])

    def covered(self, sent: Sent, bits: np.ndarray) -> np.ndarray:
        """Which bytes go."""
        gone = np.zeros(len(self.data) + 1, np.int32)
        whole = (np.uint64(1) << sent.count.astype(np.uint64)) - np.uint64(1)
        later = sent.docs[sent.which] < self.ids[sent.row]
        mine = np.where(later, whole, bits[sent.which])
        for j in range(int(sent.count.max()) if len(mine) else 0):
            at = sent.start[(mine >> np.uint64(j)) & np.uint64(1) == 1] + j
            gone += np.bincount(at, minlength=len(gone)).astype(np.int32)
            gone -= np.bincount(at + self.length, minlength=len(gone)).astype(np.int32)
        return np.cumsum(gone[:-1]) > 0


def _hash_in_blocks(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """`span_hash` of short spans in ascending order of start, with power tables of bounded size."""
    out = np.empty(len(start), np.uint64)
    for a in range(0, len(data), block):
        lo, hi = np.searchsorted(start, [a, a + block])
        if hi > lo:
            prefix = prefix_hash(data[a : int(end[lo:hi].max())])
            out[lo:hi] = span_hash(prefix, start[lo:hi] - a, end[lo:hi] - a)
    return out


def _blobs(part: np.ndarray, group: int, columns: dict[str, np.ndarray], text: np.ndarray | None = None, ends: np.ndarray | None = None) -> dict:
    """One packed row for each part; `part` is ascending."""
    head = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(part))[: len(head)]
    out = {"part": pa.array(part[head], pa.int32()), "g": pa.array(np.full(len(head), group), pa.int32())}
    for name, values in columns.items():
        out[name] = pa.array([values[a:b].tobytes() for a, b in zip(head, tail, strict=True)], pa.binary())
    if text is not None:
        out["text"] = pa.array([pa.compress(text[(ends[a - 1] if a else 0) : ends[b - 1]].tobytes(), codec="zstd", asbytes=True)
                                for a, b in zip(head, tail, strict=True)], pa.binary())
    return out


def _ask(length: int, parts: int):
    def run(rows: pa.Table) -> pa.Table:
        hashes, flags = Group(rows, length).asked()
        hashes = hashes >> np.uint64(24)  # 40 bits: a chance meeting costs work, not results
        part = (mix(hashes) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        five = hashes[order].view(np.uint8).reshape(-1, 8)[:, :5]
        return pa.table(_blobs(part[order], rows["g"][0].as_py(), {"hashes": five, "flags": flags[order]}))

    return run, "part int, g int, hashes binary, flags binary"


def _unpack5(raw: bytes) -> np.ndarray:
    five = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return np.concatenate([five, np.zeros((len(five), 3), np.uint8)], axis=1).view(np.uint64).ravel()


def _tell(hot_runs: int):
    def run(rows: pa.Table) -> pa.Table:
        lists = [_unpack5(x) for x in rows["hashes"].to_pylist()]
        flags = _joined(rows["flags"], np.uint8).astype(np.int64)
        value, at, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        several = (n > 1) | (np.bincount(at, flags & 1, minlength=len(value)) > 0)
        hot = several & (np.bincount(at, flags >> 1, minlength=len(value)) > hot_runs)
        stop = np.cumsum([len(x) for x in lists])
        places = [at[b - len(x) : b] for x, b in zip(lists, stop, strict=True)]
        return pa.table({"g": rows["g"],
                         "shared": pa.array([x[several[p]].tobytes() for x, p in zip(lists, places, strict=True)], pa.binary()),
                         "hot": pa.array([x[hot[p]].tobytes() for x, p in zip(lists, places, strict=True)], pa.binary())})

    return run, "g int, shared binary, hot binary"


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _send(length: int, parts: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({"part": pa.array([], pa.int32()), "g": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("docs", "sizes", "text")}})
        if not len(rows) or not len(answers):
            return empty
        sent = Group(rows, length).send(_joined(answers["shared"], np.uint64), _joined(answers["hot"], np.uint64), parts)
        if not len(sent.docs):
            return empty
        size = np.diff(sent.ends, prepend=0).astype(np.uint8)
        return pa.table(_blobs(sent.part, rows["g"][0].as_py(), {"docs": sent.docs.astype(np.int64), "sizes": size}, sent.text, sent.ends))

    return run, "part int, g int, docs binary, sizes binary, text binary"


def _sort(length: int):
    def run(rows: pa.Table) -> pa.Table:
        docs, sizes = _joined(rows["docs"], np.int64), [np.frombuffer(x, np.uint8).astype(np.int64) for x in rows["sizes"].to_pylist()]
        texts = b"".join(pa.decompress(x, int(n.sum()), codec="zstd", asbytes=True) for x, n in zip(rows["text"].to_pylist(), sizes, strict=True))
        bits = earliest_in_batches(np.frombuffer(texts, np.uint8), np.cumsum(np.concatenate(sizes)), docs, length).astype(np.uint32)
        many = np.cumsum([len(x) for x in sizes])
        return pa.table({"g": rows["g"], "part": rows["part"],
                         "bits": pa.array([bits[a:b].tobytes() for a, b in zip(np.append(0, many[:-1]), many, strict=True)], pa.binary())})

    return run, "g int, part int, bits binary"


_FACTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                       T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _facts(doc: int | None, raw: np.ndarray, gone: np.ndarray) -> tuple:
    kept = raw[~gone].tobytes()
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + (len(gone) > 0 and bool(gone[0]))
    return doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")


def _cut(length: int, parts: int, names: list[str]):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({n: pa.array([], k) for n, k in zip(names, [*_KINDS[: min(len(names), 6)], *(rows.schema.field(n).type for n in names[6:])], strict=True)})
        group = Group(rows, length)
        gone = np.zeros(len(group.data), bool)
        if len(answers):
            sent = group.send(_joined(answers["shared"], np.uint64), _joined(answers["hot"], np.uint64), parts)
            told = answers.filter(pc.is_valid(answers["bits"])).sort_by("part")
            if len(told):
                gone = group.covered(sent, _joined(told["bits"], np.uint32).astype(np.uint64))
        o = group.offsets
        out = [_facts(int(d), group.data[o[i] : o[i + 1]], gone[o[i] : o[i + 1]]) for i, d in enumerate(group.ids)]
        cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)]
        return pa.table([*cols[: len(names)], *(group.rows[n] for n in names[6:])], names=names)

    return run


def _untouched(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer((x or "").encode(), np.uint8) for x in batch.column(0).to_pylist()]
            out = [_facts(None, x, np.zeros(len(x), bool)) for x in raw]
            if out:
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols[: len(names)], *(batch.column(n) for n in names[6:])], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = 50, group_bytes: int = 4 << 20, hot_runs: int = 100_000, with_rows: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    `with_rows` adds kept_text, which drops the bytes of characters that a cut has split, and the struct
    `row` with the other columns of `docs`.
    """
    if not GRAM < length < GRAM + 32:
        raise ValueError("length must leave 1 to 31 places for the anchor")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                         *([F.struct(*others).alias("row")] if with_rows else []))
    schema = _FACTS
    if with_rows:
        schema = T.StructType([*_FACTS.fields, T.StructField("kept_text", T.StringType()), source.schema["row"]])
    names = schema.fieldNames()
    known = source.filter("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    groups = max(8, -(-int(total) // group_bytes))
    parts = max(8, groups // 2)
    grouped = known.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
    ask, ask_schema = _ask(length, parts)
    tell, tell_schema = _tell(hot_runs)
    answers = grouped.groupBy("g").applyInArrow(ask, ask_schema).groupBy("part").applyInArrow(tell, tell_schema)
    send, send_schema = _send(length, groups)
    order, order_schema = _sort(length)
    bits = (grouped.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(send, send_schema)
            .groupBy("part").applyInArrow(order, order_schema))
    none = F.lit(None)
    both = (answers.select("g", none.cast("int").alias("part"), none.cast("binary").alias("bits"), "shared", "hot")
            .unionByName(bits.select("g", "part", "bits", F.lit(b"").alias("shared"), F.lit(b"").alias("hot"))))
    done = grouped.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(_cut(length, groups, names), schema)
    rest = source.filter("doc_id is null").drop("doc_id").mapInArrow(_untouched(names), schema)
    return done.unionByName(rest)
