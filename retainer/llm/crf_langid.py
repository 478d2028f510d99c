"""Language identification by a linear-chain conditional random field (operator 2).

Words (runs of letters) of a text form a chain.  A word's features are its byte n-grams with
boundary marks (those at a boundary are its affixes) and the word itself (lexicon), all hashed
into one weight table; transitions between the languages of neighbouring words are learned.
Forward-backward gives every word's language distribution, so code-switched texts are read word by
word; a document's language is the one with the largest expected share of words, which is its score.

Training (driver, bounded sample): word weights are first fitted to document labels, each word is
relabelled by a sticky chain under those weights (so a passage in another language is not learned
under the document's label), and then weights and transitions are fitted by likelihood gradients.

Prediction is numpy over whole batches: the chain of all documents of a chunk is cut into
blocks whose transfer matrices are multiplied side by side; a document's first word resets the
chain.  Texts are whole, of any length.

Nulls: a null text, or one with no letter, gets `und` and score 0; a null doc_id is carried with a
null held_out.  Rows without language are never learned from.  Ties go to the smaller name.
With nothing to learn from, every text is `und`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retainer.llm.textops import LOWER, chunks, mix, prefix_hash, span_hash, string_array
from retainer.llm.workspace import only, remainder

UNKNOWN = "und"
_EDGE = 1
_BITS = 17
_BLOCK = 128
_FOLD = LOWER.copy()  # lower case; ASCII other than letters is an edge
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = _EDGE


@dataclass
class Words:
    """Feature positions of the words of a chunk."""

    grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # features, first of each distinct word, distinct word of each
    lexicon: np.ndarray  # feature of each distinct word
    which: np.ndarray  # distinct word of each word
    row: np.ndarray  # document of each word
    first: np.ndarray  # whether a word is the first of its document


def letters_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes with every non-letter as edge, word starts, word ends, document of each word)."""
    low = np.append(_FOLD[data], np.full(3, _EDGE, np.uint8))
    wide = np.flatnonzero(data >= 0xC2)
    lead = low[wide]
    capital = wide[lead == 0xC3] + 1
    capital = capital[(low[capital] >= 0x80) & (low[capital] <= 0x9E) & (low[capital] != 0x97)]
    low[capital] += 0x20  # capital accented Latin letters
    sign = wide[lead == 0xC2]  # signs of Latin-1 and general punctuation are no letters
    low[sign] = low[sign + 1] = _EDGE
    sign = wide[lead == 0xE2]
    sign = sign[(low[sign + 1] == 0x80) | (low[sign + 1] == 0x81)]
    low[sign] = low[sign + 1] = low[sign + 2] = _EDGE
    letter = np.zeros(len(data) + 2, bool)
    np.not_equal(low[: len(data)], _EDGE, out=letter[1:-1])
    turn = np.flatnonzero(letter[1:] != letter[:-1])
    start, end = turn[::2], turn[1::2]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    split = np.unique(inner[letter[inner] & letter[inner + 1]])  # words that touch at a document's end
    if len(split):
        start, end = np.sort(np.append(start, split)), np.sort(np.append(end, split))
    return low, start, end, np.searchsorted(offsets, start, "right") - 1


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of a chunk of texts, and hashed features of the distinct ones."""
    low, start, end, row = letters_of(data, offsets)
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    cuts = np.empty(2 * len(start) + 1, np.int64)
    cuts[:-1:2], cuts[1::2], cuts[-1] = start, end, len(low)
    coded = string_array(low, cuts).take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    low = np.full(1, _EDGE, np.uint8)
    begin = np.zeros(0, np.int64)
    if len(coded.dictionary):
        spelled = coded.dictionary
        ends = np.frombuffer(spelled.buffers()[1], np.int64)[spelled.offset : spelled.offset + len(spelled) + 1]
        text = np.frombuffer(spelled.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        low = np.concatenate([low, np.insert(text, ends[1:], _EDGE)])
        begin = ends[:-1] + np.arange(1, len(ends))
        whole = span_hash(prefix_hash(low), begin, begin + np.diff(ends))
    else:
        whole = np.zeros(0, np.uint64)
    size, shift = len(low), np.uint32(32 - _BITS)
    low = np.concatenate([low, np.full(4, _EDGE, np.uint8)])
    letter = low != _EDGE
    key, inside, grams = np.zeros(size, np.uint32), np.ones(size, bool), []
    for n in range(1, 5):
        key = key | (low[n - 1 : size + n - 1].astype(np.uint32) << np.uint32(8 * (n - 1)))
        if n > 2:
            inside &= letter[n - 2 : size + n - 2]
        at = np.flatnonzero(letter[:size] if n == 1 else inside & (letter[:size] | letter[1 : size + 1]))
        hashed = (key[at] * np.uint32(2654435761) + np.uint32(n * 0x1B873593)) * np.uint32(0x9E3779B1)
        grams.append(((hashed >> shift).astype(np.int32), np.searchsorted(at, begin - 1), np.searchsorted(begin, at + 1, "right") - 1))
    return Words(grams, (mix(whole) >> np.uint64(64 - _BITS)).astype(np.int32), which, row, first)


def emissions(words: Words, weight: np.ndarray) -> np.ndarray:
    """Summed feature weights of each word (words x labels)."""
    if not len(words.lexicon):
        return np.zeros((0, weight.shape[1]), np.float32)
    total = np.empty((len(words.lexicon), weight.shape[1]), np.float32)
    for y in range(weight.shape[1]):
        column = np.ascontiguousarray(weight[:, y])
        total[:, y] = column.take(words.lexicon)
        for feature, begin, _ in words.grams:
            total[:, y] += np.add.reduceat(column.take(feature), begin)
    return total.take(words.which, axis=0)


def forward_backward(score: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False):
    """(distribution of each word, expected transitions or None) of the chain, restarted at `first` words."""
    n, k = score.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    blocks = -(-n // _BLOCK)

    def stepwise(x: np.ndarray, fill) -> np.ndarray:
        """Padded to whole blocks, with the place within the block as first axis."""
        full = np.full((blocks * _BLOCK, *x.shape[1:]), fill, x.dtype)
        full[:n] = x
        return np.ascontiguousarray(full.reshape(blocks, _BLOCK, *x.shape[1:]).swapaxes(0, 1))

    e = stepwise(np.exp(score - score.max(axis=1, keepdims=True), dtype=np.float64), 1.0)
    reset = stepwise(first, True)
    resets = [np.flatnonzero(r) for r in reset]
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(_BLOCK):
        step = (product.reshape(-1, k) @ move).reshape(blocks, k, k)
        if (r := resets[t]).size:
            step[r] = product[r].sum(axis=2, keepdims=True) * start
        step *= e[t][:, None, :]
        if t % 4 == 3:
            step *= (1 / step.reshape(blocks, -1).sum(axis=1))[:, None, None]
        product = step
    into, out = np.empty((blocks, k)), np.empty((blocks, k))
    v = np.full(k, 1 / k)
    for b in range(blocks):
        into[b] = v
        v = v @ product[b]
        v /= v.sum()
    v = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        out[b] = v
        v = product[b] @ v
        v /= v.sum()
    ones = np.ones((k, 1))
    alpha, beta = np.empty((_BLOCK, blocks, k)), np.empty((_BLOCK, blocks, k))
    v = into
    for t in range(_BLOCK):
        v = v @ move
        v[resets[t]] = start
        v *= e[t]
        v /= v @ ones
        alpha[t] = v
    v = out
    for t in range(_BLOCK - 1, -1, -1):
        beta[t] = v
        v = (e[t] * v) @ move.T
        v[resets[t]] = 1.0
        v /= v @ ones
    e, alpha, beta = (x.swapaxes(0, 1) for x in (e, alpha, beta))
    gamma = alpha * beta
    gamma /= gamma @ ones
    expected = None
    if pairs:
        a, b = alpha.reshape(-1, k)[: n - 1], (e * beta).reshape(-1, k)[1:n]
        inner = ~first[1:]
        a, b = a[inner], b[inner]
        z = np.einsum("ni,ij,nj->n", a, move, b)
        expected = np.einsum("ni,nj->ij", a / z[:, None], b) * move
    return gamma.reshape(-1, k)[:n], expected


class Crf:
    """Weights of a fitted field; `labels` in ascending order."""

    def __init__(self, labels: list[str]):
        self.labels, k = labels, max(1, len(labels))
        self.weight = np.zeros((1 << _BITS, k), np.float32)
        self.start, self.move = np.full(k, 1 / k), np.full((k, k), 1 / k)

    def fit(self, texts: list[str], langs: list[str], passes: int = 6, rate: float = 0.2) -> Crf:
        """Fit to labelled documents; see the module text."""
        if not self.labels:
            return self
        k = len(self.labels)
        target = np.array([self.labels.index(x) for x in langs])
        parts = [(words_of(d, o), target[i : i + len(o) - 1]) for i, d, o in chunks(pa.array(texts), 1 << 18)]
        parts = [(w, t) for w, t in parts if len(w.row)]
        square = np.full(self.weight.shape, 1e-3, np.float32)

        def update(w: Words, gradient: np.ndarray) -> None:
            g = np.zeros(self.weight.shape, np.float32)
            distinct = np.stack([np.bincount(w.which, gradient[:, y], minlength=len(w.lexicon)) for y in range(k)], axis=1)
            for y in range(k):
                g[:, y] += np.bincount(w.lexicon, distinct[:, y], minlength=len(g))
                for feature, _, owner in w.grams:
                    g[:, y] += np.bincount(feature, distinct[owner, y], minlength=len(g))
            g /= max(1, len(w.row)) / 1000
            np.add(square, g * g, out=square)
            self.weight += rate * g / np.sqrt(square)

        def softmax(x: np.ndarray) -> np.ndarray:
            p = np.exp(x - x.max(axis=1, keepdims=True))
            return p / p.sum(axis=1, keepdims=True)

        eye = np.eye(k)
        for _ in range(passes // 2):
            for w, t in parts:
                update(w, eye[t[w.row]] - softmax(emissions(w, self.weight)))
        sticky = np.full((k, k), 0.03 / max(1, k - 1))
        np.fill_diagonal(sticky, 0.97)
        gold = [forward_backward(0.5 * emissions(w, self.weight), w.first, np.full(k, 1 / k), sticky)[0].argmax(axis=1) for w, _ in parts]
        begin, seen = np.ones(k), np.ones((k, k))
        for (w, _), g in zip(parts, gold, strict=True):
            begin += np.bincount(g[w.first], minlength=k)
            inner = ~w.first[1:]
            np.add.at(seen, (g[:-1][inner], g[1:][inner]), 1)
        self.start, self.move = begin / begin.sum(), seen / seen.sum(axis=1, keepdims=True)
        for _ in range(passes):
            for (w, _), g in zip(parts, gold, strict=True):
                marginal, expected = forward_backward(emissions(w, self.weight), w.first, self.start, self.move, pairs=True)
                update(w, eye[g] - marginal)
                inner = ~w.first[1:]
                real = np.zeros((k, k))
                np.add.at(real, (g[:-1][inner], g[1:][inner]), 1)
                logits = np.log(self.move) + 0.5 * (real - expected) / max(1, inner.sum())
                self.move = softmax(logits)
        return self

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Expected share of each label in each text of a chunk (texts x labels)."""
        w = words_of(data, offsets)
        k = len(self.start)
        share = np.tile(self.start, (len(offsets) - 1, 1))
        if len(w.row):
            marginal, _ = forward_backward(emissions(w, self.weight), w.first, self.start, self.move)
            at = np.flatnonzero(w.first)
            share[w.row[at]] = np.add.reduceat(marginal, at, axis=0)
        return (share / share.sum(axis=1, keepdims=True)).reshape(-1, k)


def fit(docs: DataFrame, train_rows: int = 1200, train_max_bytes: int = 65536, least: int = 24) -> Crf:
    """Fit on a bounded sample of the labelled rows of `docs` (doc_id, text, lang).

    The sample: the `train_rows` rows with the smallest hash of doc_id among those with language, text of at
    most `train_max_bytes` bytes and a letter.  Both bounds limit what the driver holds.  A language with fewer than
    `least` of them (or its share of `train_rows`, if that is less) gets that many rows of its own, the smallest hashes
    first and longer texts last, by their beginning; more than `train_rows` languages raise.
    """
    labelled = (only(docs, "doc_id", "text", "lang")
                .filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")))
    short = F.octet_length("text") <= train_max_bytes
    rows = labelled.filter(short)
    chosen = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(train_rows)
    picked = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id").orderBy("doc_id", "lang", "text").limit(2 * train_rows).collect()
    langs = [r["lang"] for r in labelled.select("lang").distinct().limit(train_rows + 1).collect()]
    if len(langs) > train_rows:
        raise ValueError(f"more than {train_rows} languages")
    have = Counter(r["lang"] for r in picked)
    least = min(least, train_rows // max(1, len(langs)))
    if rare := [x for x in langs if have[x] < least]:
        part = F.when(short, F.col("text")).otherwise(F.substring("text", F.regexp_instr("text", F.lit(r"\p{L}")), F.lit(train_max_bytes // 4)))
        own = labelled.filter(F.col("lang").isin(rare))
        order = Window.partitionBy("lang").orderBy("long", "h", "doc_id")
        first = (own.select("doc_id", "lang", (~short).alias("long"), F.xxhash64("doc_id").alias("h")).groupBy("doc_id", "lang", "h").agg(F.min("long").alias("long"))
                 .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= least).select("doc_id", "lang"))
        extra = own.join(F.broadcast(first), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min(part).alias("text")).orderBy("doc_id", "lang").collect()
        known = {(r["doc_id"], r["lang"]) for r in picked}
        picked += [r for r in extra if (r["doc_id"], r["lang"]) not in known]
    return Crf(sorted({r["lang"] for r in picked})).fit([r["text"] for r in picked], [r["lang"] for r in picked])


def _label(model: Crf, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array(model.labels or [UNKNOWN], object)
        for batch in batches:
            text = batch.column("text")
            pred, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
            if model.labels:
                for i, data, offsets in chunks(text, 4 << 20):
                    share = model.predict(data, offsets)
                    pred[i : i + len(share)] = labels[share.argmax(axis=1)]
                    score[i : i + len(share)] = share.max(axis=1)
                none = ~np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False))
                pred[none], score[none] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))],
                                             names=[*batch.schema.names, *names])

    return run


def identify(docs: DataFrame, model: Crf, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` (any columns, among them text) with the predicted language and its score, called `names`."""
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(_label(model, names), schema)


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row; learns from rows whose crc32(doc_id) mod `folds` is not `held_out`."""
    source = only(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    out = remainder("doc_id", folds) == held_out
    model = fit(source.filter(~out), **bounds)
    return identify(source.select("doc_id", out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
