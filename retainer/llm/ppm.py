"""Language-model scoring by prediction by partial matching (operator 6).

The model is a trie of byte contexts up to `ORDER` bytes with the counts of the bytes that follow them in
the training documents.  A byte is coded at the longest context in which it was seen; every shorter step
costs an escape (method C: as many escape counts as distinct successors), and successors of the
longer context are excluded from the shorter one.  Byte 0 marks both ends of a text, so the end is coded too
(a NUL within a text is coded like an end).  Since the pretrained trie is fixed, the code length of a byte depends on
its last `ORDER` bytes alone, so each distinct gram is computed once for the whole corpus.

Data flow (all tables packed: one row holds many sorted keys):

* texts are dealt by a hash of doc_id and text into groups of about `group_bytes`; a group asks about its distinct words
  and grams, with their training counts, dealt by key hash;
* per deal counts are added up; the distinct grams go once more by the last two bytes of their context, where the
  whole subtree of orders 2 and up is at hand (its size is bounded by the alphabet); orders 0 and 1 are
  one table of at most 65,536 rows, which the driver hands out;
* answers go back to the groups, which sum them per document.

The unigram base counts words (runs of bytes other than ASCII white space, A-Z lower-cased) and one end per text.
Words are told apart by a 64-bit hash.

Nulls: a null text is empty (its end alone is scored); a row with null doc_id is scored, with null held_out, and not
learned from.  Repeated rows count as often as they occur.  Without training text every byte costs log10 256.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainer.llm.textops import LOWER, chunks, mix, prefix_hash, span_hash, word_spans
from retainer.llm.workspace import materialize, only, remainder

ORDER = 4
_ROW_BITS = 24


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row) of every byte and end: the ORDER bytes before it and itself, first byte highest."""
    n = len(offsets) - 1
    padded = np.zeros(len(data) + ORDER * (n + 1), np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(data)) + ORDER * (row + 1)] = data
    wide = padded.astype(np.uint64)
    size = len(padded) - ORDER
    key = np.zeros(size, np.uint64)
    for j in range(ORDER + 1):
        key = (key << np.uint64(8)) | wide[j : j + size] if j else wide[:size].copy()
    coded = np.ones(size, bool)
    ends = offsets[1:] + ORDER * np.arange(n)  # of each text, counted without the first pad
    for j in range(1, ORDER):
        coded[(ends + j)[ends + j < size]] = False
    rows = np.repeat(np.arange(n), np.diff(offsets) + 1)
    return key[coded], rows


class Asked:
    """Distinct words and grams of a document group and their places in its texts."""

    def __init__(self, rows: pa.Table):
        self.size = len(rows)
        if self.size >= 1 << _ROW_BITS:
            raise ValueError("a document group holds too many rows; lower group_bytes")
        train = np.asarray(rows["train"].to_numpy(zero_copy_only=False), bool)
        word, word_row, packed = [], [], []  # 32-bit places: a group's bytes fit them by far
        for i, data, offsets in chunks(rows["text"], 1 << 20):
            key, row = grams(data, offsets)
            packed.append((key << np.uint64(_ROW_BITS)) | (row + i).astype(np.uint64))
            low = LOWER[data]
            start, end, at = word_spans(low, offsets)
            word.append(span_hash(prefix_hash(low), start, end))
            word_row.append(at + i)
        self.word_row = np.concatenate(word_row)
        self.words, self.word_at = np.unique(np.concatenate(word), return_inverse=True)
        self.word_counts = np.bincount(self.word_at[train[self.word_row]], minlength=len(self.words)).astype(np.uint32)
        packed = np.concatenate(packed)
        packed.sort()
        self.gram_row = packed.astype(np.int32) & np.int32((1 << _ROW_BITS) - 1)  # the low bits hold the row
        packed >>= np.uint64(_ROW_BITS)
        fresh = np.append(True, packed[1:] != packed[:-1])
        self.grams = packed[fresh]
        del packed
        self.gram_at = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        self.gram_counts = np.bincount(self.gram_at[train[self.gram_row]], minlength=len(self.grams)).astype(np.uint32)

    def dealt(self, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(order by part, bounds of the parts) of sorted keys; within a part they stay sorted."""
        part = (mix(keys ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(parts + 1))


def _ask(parts: int):
    def run(rows: pa.Table) -> pa.Table:
        asked = Asked(rows)
        (wo, wb), (go, gb) = asked.dealt(asked.words, parts), asked.dealt(asked.grams, parts)
        cut = lambda x, b: pa.array([x[b[i] : b[i + 1]].tobytes() for i in range(parts)], pa.binary())
        return pa.table({"part": pa.array(np.arange(parts), pa.int32()), "g": pa.array([rows["g"][0].as_py()] * parts, pa.int32()),
                         "words": cut(asked.words[wo], wb), "word_counts": cut(asked.word_counts[wo], wb),
                         "grams": cut(asked.grams[go], gb), "gram_counts": cut(asked.gram_counts[go], gb)})

    return run, "part int, g int, words binary, word_counts binary, grams binary, gram_counts binary"


def _arrays(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their added counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts).astype(np.float64), minlength=len(distinct)).astype(np.int64)


def _merge(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        words, counts = summed(_arrays(rows["words"], np.uint64), _arrays(rows["word_counts"], np.uint32))
        keys, n = summed(_arrays(rows["grams"], np.uint64), _arrays(rows["gram_counts"], np.uint32))
        low = np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), n, minlength=65536)
        at = np.flatnonzero(low)
        bucket = (mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bound = np.searchsorted(bucket[order], np.arange(buckets + 1))
        empty = [None] * buckets
        cut = lambda x: pa.array([None, *(x[order][bound[i] : bound[i + 1]].tobytes() for i in range(buckets))], pa.binary())
        return pa.table({"bucket": pa.array([-1, *range(buckets)], pa.int32()), "part": pa.array([part] * (buckets + 1), pa.int32()),
                         "keys": cut(keys), "counts": cut(n), "total": pa.array([int(counts.sum()), *empty], pa.int64()),
                         "distinct": pa.array([int((counts > 0).sum()), *empty], pa.int64()),
                         "low": pa.array([at.tolist(), *empty], pa.list_(pa.int32())),
                         "low_counts": pa.array([low[at].astype(np.int64).tolist(), *empty], pa.list_(pa.int64()))})

    return run, ("bucket int, part int, keys binary, counts binary, total long, distinct long, low array<int>, low_counts array<long>")


def code_lengths(keys: np.ndarray, counts: np.ndarray, pair_counts: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each distinct gram after the others.

    `keys` holds all grams with training counts whose contexts end in the same two bytes as any key here;
    `pair_counts` (256 x 256) holds the counts of all byte pairs.
    """
    result = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    last = (keys & np.uint64(0xFF)).astype(np.int64)
    longer = None  # (distinct context of order+1 of each key, its successor flags by key, ...)
    for order in range(ORDER, -1, -1):
        mask = np.uint64((1 << (8 * (order + 1))) - 1)
        if order >= 2:
            step, at = np.unique(keys & mask, return_inverse=True)
            n = np.bincount(at, counts, minlength=len(step))
            context, own = np.unique(step >> np.uint64(8), return_inverse=True)
            total = np.bincount(own, n, minlength=len(context))
            kinds = np.bincount(own, n > 0, minlength=len(context))
            seen, size, distinct = n[at], total[own][at], kinds[own][at]
            place = own[at]  # context of each key
        elif order == 1:
            byte = ((keys >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)
            seen, size, distinct = pair_counts[byte, last], pair_counts.sum(axis=1)[byte], (pair_counts > 0).sum(axis=1)[byte]
        else:
            single = pair_counts.sum(axis=0)
            seen, size, distinct = single[last], np.full(len(keys), single.sum()), np.full(len(keys), (single > 0).sum())
        if longer is not None:  # successors of the longer context are excluded here
            step_longer, n_longer, place_longer, contexts_longer, kinds_longer = longer
            had = n_longer > 0
            byte = (step_longer & np.uint64(0xFF)).astype(np.int64)
            if order >= 2:
                inner = n[np.searchsorted(step, step_longer & mask)]
            elif order == 1:
                inner = pair_counts[((step_longer >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64), byte]
            else:
                inner = single[byte]
            gone = np.bincount(place_longer[had], inner[had], minlength=contexts_longer)
            size, distinct = size - gone[key_place], distinct - kinds_longer[key_place]
        room = size + distinct
        hit = open_ & (seen > 0)
        result[hit] += np.log10(seen[hit] / room[hit])
        open_ &= ~hit
        pay = open_ & (size > 0)
        result[pay] += np.log10(distinct[pay] / room[pay])
        if order >= 2:
            longer = step, n, own, len(context), kinds
            key_place = place
        elif order == 1:
            # every successor of the byte, as (byte, next) pairs
            a, b = np.nonzero(pair_counts)
            longer = (a.astype(np.uint64) << np.uint64(8)) | b.astype(np.uint64), pair_counts[a, b], a, 256, (pair_counts > 0).sum(axis=1)
            key_place = ((keys >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)
    known = int((pair_counts.sum(axis=0) > 0).sum())
    result[open_] -= np.log10(max(1, 256 - known))
    return result


def _weigh(parts_column: str, low_keys: np.ndarray, low_counts: np.ndarray):
    def run(rows: pa.Table) -> pa.Table:
        pair = np.zeros(65536)
        pair[low_keys] = low_counts
        lists = _arrays(rows["keys"], np.uint64)
        keys, counts = np.concatenate(lists), np.concatenate(_arrays(rows["counts"], np.int64))
        value = code_lengths(keys, counts.astype(np.float64), pair.reshape(256, 256))
        stop = np.cumsum([len(x) for x in lists])
        return pa.table({parts_column: rows["part"], "known": rows["keys"],
                         "known_values": pa.array([value[b - len(x) : b].tobytes() for x, b in zip(lists, stop, strict=True)], pa.binary())})

    return run, f"{parts_column} int, known binary, known_values binary"


def _answer():
    def run(rows: pa.Table, weighed: pa.Table) -> pa.Table:
        lists = _arrays(rows["words"], np.uint64)
        words, counts = summed(lists, _arrays(rows["word_counts"], np.uint32))
        known, value = np.concatenate(_arrays(weighed["known"], np.uint64)), np.concatenate(_arrays(weighed["known_values"], np.float64))
        order = np.argsort(known)
        known, value = known[order], value[order]
        return pa.table({"g": rows["g"], "part": rows["part"],
                         "counts": pa.array([counts[np.searchsorted(words, x)].tobytes() for x in lists], pa.binary()),
                         "values": pa.array([value[np.searchsorted(known, x)].tobytes() for x in _arrays(rows["grams"], np.uint64)], pa.binary())})

    return run, "g int, part int, counts binary, values binary"


def _score(parts: int, total: int, distinct: int, ends: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        asked = Asked(rows)
        answers = answers.sort_by("part")
        counts, values = np.zeros(len(asked.words)), np.zeros(len(asked.grams))
        counts[asked.dealt(asked.words, parts)[0]] = np.concatenate(_arrays(answers["counts"], np.int64))
        values[asked.dealt(asked.grams, parts)[0]] = np.concatenate(_arrays(answers["values"], np.float64))
        n = asked.size
        tokens = np.bincount(asked.word_row, minlength=n) + 1
        known = np.bincount(asked.word_row, (counts > 0)[asked.word_at], minlength=n).astype(np.int64) + (ends > 0)
        base = np.bincount(asked.word_row, np.log10(counts + 1)[asked.word_at], minlength=n) + np.log10(ends + 1)
        base -= tokens * np.log10(total + distinct + 1)
        score = np.bincount(asked.gram_row, values[asked.gram_at], minlength=n)
        return pa.table([rows["doc_id"], rows["held_out"], pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                         pa.array(np.full(n, total), pa.int64()), pa.array(base), pa.array(score)], names=names)

    return run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, group_bytes: int = 8 << 20, buckets: int = 64) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id) mod `folds` is not `held_out`.
    """
    out = remainder("doc_id", folds) == held_out
    source = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text") + 16).alias("bytes"), F.count_if(~out).alias("ends")).first()
    groups = max(8, -(-int(size["bytes"] or 0) // group_bytes))
    parts = max(8, groups // 4)
    grouped = source.select("doc_id", "text", out.alias("held_out"), F.coalesce(~out, F.lit(False)).alias("train"),
                            F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g"))
    ask, ask_schema = _ask(parts)
    asked = materialize(grouped.groupBy("g").applyInArrow(ask, ask_schema), "ppm-asked")
    merge, merge_schema = _merge(buckets)
    merged = materialize(asked.groupBy("part").applyInArrow(merge, merge_schema), "ppm-merged")
    sums = merged.agg(F.sum("total"), F.sum("distinct")).first()
    low = (merged.filter("bucket = -1").select(F.explode(F.arrays_zip("low", "low_counts")).alias("x"))
           .groupBy("x.low").agg(F.sum("x.low_counts").alias("n")).collect())  # at most 65,536 rows
    weigh, weigh_schema = _weigh("part", np.array([r["low"] for r in low], np.int64), np.array([r["n"] for r in low], np.float64))
    weighed = merged.filter("bucket >= 0").groupBy("bucket").applyInArrow(weigh, weigh_schema)
    answer, answer_schema = _answer()
    answers = asked.groupBy("part").cogroup(weighed.groupBy("part")).applyInArrow(answer, answer_schema)
    ends = int(size["ends"])
    done, done_schema = _score(parts, int(sums[0] or 0) + ends, int(sums[1] or 0) + (ends > 0), ends)
    return grouped.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(done, done_schema)
