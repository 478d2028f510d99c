"""MinHash near-duplicates with odd sketches (operator 10).

A document's set holds the hashes of its distinct word shingles.  `k = bands * rows`
MinHash samples are folded into a parity bitmap (odd sketch): sample `i` with value `x`
flips bit `hash(i, x)`.  For two documents the population count of the XOR tells how many
samples differ, hence the similarity, most precisely where it is high.  Banded keys bring
candidates together, the sketch rejects those far below the threshold, and the full sets
decide.

Work is kept linear in a group's size:

* documents with equal sets are one class, whatever their ids (a doc_id that occurs with several texts has several classes);
* round 1 compares each class with one pivot, the best by sketch among the first members of its buckets;
* round 2 looks only at fields, components that buckets connect, and there only at classes that share a prefix shingle
  with another component.  A class's shingles are put in one order for all, by rising (bucketed) frequency; of two similar
  sets at least one shingle lies in the first `size - ceil(0.8 size) + 1` of each, so text that many pages share makes no
  candidates.  Components linked by such candidates form an area; in each area the members outside its largest component
  are compared with all others, in blocks of bounded size, nearest sketches first, and not at all once their
  components are linked.  Only links leave a block.

A pair that shares a bucket and passes the sketch is thus either compared on full sets, known to be less similar, or
already connected.  Defaults: a pair at exactly 0.8 shares none of 32 bands of 5 rows with
probability 3e-6; the sketch rejects it at 5 standard deviations.

Nulls: a null text is an empty one (no set, linked with nothing); a null doc_id gets a null
component and is kept.  Repeated rows keep their number; each gets its document's result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retainer.llm import textops
from retainer.llm.graph import components
from retainer.llm.workspace import materialize, only

SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
_ONE = np.uint64(0x632BE59BD9B4E019)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a chunk."""
    lowered = textops.LOWER[data]
    start, end, row = textops.word_spans(lowered, offsets)
    word = textops.span_hash(textops.prefix_hash(lowered), start, end)
    first = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        width = min(words, n)
        h = np.full(n - width + 1, np.uint64(width), np.uint64)
        for j in range(width):
            h = textops.mix(h * _ONE + word[a + j : b - width + 1 + j])
        out.append(np.unique(h))
    return out


class Sketcher:
    """MinHash samples, band keys and odd sketches of shingle sets."""

    def __init__(self, bands: int, rows: int, seed: int = 10):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.mul = rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 2**32, k, dtype=np.uint32)
        self.salt = rng.integers(0, 2**64, k, dtype=np.uint64)

    def samples(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.mul), 2**32 - 1, np.uint32)
        x = (s >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 256):
            low = np.minimum(low, (x[i : i + 256, None] * self.mul + self.add).min(axis=0))
        return low

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """Band keys (documents x bands); the band number is part of the key."""
        m = samples.reshape(len(samples), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) * _ONE, m.shape[:2]).copy()
        for j in range(self.rows):
            key = textops.mix(key * _ONE + m[:, :, j])
        return key.view(np.int64)

    def odd(self, samples: np.ndarray) -> np.ndarray:
        """Odd sketches (documents x SKETCH_WORDS)."""
        bit = (textops.mix(samples.astype(np.uint64) + self.salt) % np.uint64(SKETCH_BITS)).astype(np.int64)
        flat = (bit + np.arange(len(bit))[:, None] * SKETCH_BITS).ravel()
        parity = (np.bincount(flat, minlength=len(bit) * SKETCH_BITS) & 1).astype(np.uint8)
        return np.packbits(parity.reshape(-1, SKETCH_BITS), axis=1).view(np.int64)


def most_differing(k: int, similarity: float) -> int:
    """XOR population count expected of two sketches of `k` samples at this similarity."""
    return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * k * (1 - similarity))))


def _signatures(words: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                        ("sketch", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bands, rows)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for i, data, offsets in textops.chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, words)
                samples = np.array([sketcher.samples(s) for s in sets]).reshape(len(sets), -1)
                odd, keys = sketcher.odd(samples), sketcher.keys(samples)
                empty = np.array([not len(s) for s in sets])
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
                         for x in (odd, keys)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, len(sets)), batch.column(2).slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([None if e else _digest(s) for s, e in zip(sets, empty, strict=True)], pa.binary()), *lists], schema=schema)

    return run, "doc_id long, mark binary, n_shingles long, digest binary, sketch array<long>, keys array<long>"


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in textops.chunks(batch.column(0)):
                sets = shingle_sets(data, offsets, words)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, len(sets)), batch.column(2).slice(i, len(sets)),
                                                  pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "pivot", "members"])

    return run, "node long, pivot boolean, members array<long>"


def _differing(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, SKETCH_WORDS)),
               F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (u: a pivot, v) whose full sets are similar enough."""
    a = sets.filter("pivot").select(F.col("node").alias("u"), F.col("members").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("members").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return (pairs.join(b, "v").join(a, "u").withColumn("both", both)
            .filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("su") + F.size("sv") - F.col("both")))
            .select("u", "v"))


def _block_links(percent: int, most: int):
    """Links between the rows of side 0 and side 1 that join components; each pair of components is linked once."""

    def run(rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        docs, component = rows["doc"].to_numpy(), rows["c"].to_numpy()
        sketch = np.array(rows["sketch"].to_pylist(), np.int64).reshape(len(rows), -1).view(np.uint64)
        lists = rows["members"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        flat, ends = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        size = np.diff(ends)
        parent = {int(c): int(c) for c in component}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        right, out = np.flatnonzero(side == 1), []
        for i in np.flatnonzero(side == 0):
            differing = np.bitwise_count(sketch[right] ^ sketch[i]).sum(axis=1)
            near = (differing <= most) & (component[right] != component[i])
            near &= 100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i])
            for j in right[near][np.argsort(differing[near], kind="stable")]:
                x, y = root(int(component[i])), root(int(component[j]))
                if x == y:
                    continue
                at = np.searchsorted(sets[j], sets[i])
                both = np.count_nonzero(sets[j][np.minimum(at, size[j] - 1)] == sets[i])
                if 100 * both >= percent * (size[i] + size[j] - both):
                    parent[max(x, y)] = min(x, y)
                    out.append((int(min(docs[i], docs[j])), int(max(docs[i], docs[j]))))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return run, "u long, v long"


#: Counters of shingle frequencies: a fixed 4 MB that is broadcast.
COUNTERS, CHUNK = 1 << 20, 1 << 16


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a list column."""
    return column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles occur in `sets` (members), by the low bits of their hashes."""
    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount((_lists(batch.column(0))[0] & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        parts = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["chunk", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in rows["counts"].to_pylist())
        return pa.table({"chunk": rows["chunk"][:1], "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    schema = "chunk int, counts binary"
    found = sets.select("members").mapInArrow(count, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    out = np.zeros(COUNTERS, np.int32)
    for r in found:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int32)
    return out


def _prefixes(sent, percent: int):
    """(token, node, c) of each set's prefix: its rarest shingles, of which a similar set has one in its own prefix.

    A token stands for a shingle in the set's field (the components that open buckets connect).  A shingle counted once occurs in no other set and is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            nodes, cs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, ends = _lists(batch.column(3))
            keys, bounds = _lists(batch.column(2))
            often = counts[(flat & np.uint64(COUNTERS - 1)).astype(np.int64)]
            row = np.repeat(np.arange(len(nodes)), np.diff(ends))
            order = np.lexsort((flat, often, row))
            size = np.diff(ends)[row]
            kept = order[(np.arange(len(flat)) - ends[:-1][row] < size + (-size * percent // 100) + 1) & (often[order] > 1)]
            for i in range(0, len(kept), 1 << 16):
                part = kept[i : i + (1 << 16)]
                each = np.diff(bounds)[row[part]]
                at = np.repeat(np.arange(len(part)), each)
                key = keys[bounds[:-1][row[part]][at] + np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)]
                token = textops.mix(flat[part][at] ^ textops.mix(key))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(nodes[row[part]][at]), pa.array(cs[row[part]][at])], names=["token", "node", "c"])

    return run, "token long, node long, c long"


def _rest(placed: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, most: int, block: int) -> DataFrame:
    """Links between components that share a bucket, in blocks of at most about `block` classes a side."""
    several = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key", "lo")
    open_ = materialize(placed.join(several, "key").select("node", "c", "lo").distinct(), "odd-met")
    # a component hangs on the least of its buckets' minima; only edges between minima remain
    minima = open_.groupBy("c").agg(F.min("lo").alias("least"))
    between = open_.select("c", "lo").distinct().join(minima, "c").select(F.col("least").alias("u"), F.col("lo").alias("v"))
    fields = components(between.union(minima.select(F.col("c").alias("u"), F.col("least").alias("v"))).distinct())
    open_ = open_.select("node", "c").distinct().join(fields.select(F.col("node").alias("c"), F.array("component").alias("keys")), "c")
    held = materialize(open_.join(sets.select("node", "members"), "node").select("node", "c", "keys", "members"), "odd-open")
    run, schema = _prefixes(held.sparkSession.sparkContext.broadcast(_frequencies(held)), percent)
    tokens = materialize(held.mapInArrow(run, schema), "odd-prefixes")
    met = materialize(tokens.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("token", "lo"), "odd-met")
    near = materialize(tokens.join(met, "token").select("node", "c", "lo").distinct(), "odd-near")
    areas = components(near.select(F.col("c").alias("u"), F.col("lo").alias("v")).distinct())
    members = near.select("node", "c").distinct().join(areas.withColumnRenamed("node", "u"), F.col("c") == F.col("u")).select("node", "c", F.col("component").alias("area"))
    members = materialize(members, "odd-members")
    counts = members.groupBy("area", "c").agg(F.count("*").alias("n"))
    area = (counts.groupBy("area").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("n"))
            .select("area", F.col("m.c").alias("main"), F.ceil((F.col("n") - F.col("m.n")) / block).cast("int").alias("nl"),
                    F.ceil(F.col("n") / block).cast("int").alias("nr")).filter("nl > 0"))
    full = members.join(area, "area").join(sketches, "node").join(held.select("node", "members"), "node").withColumnRenamed("node", "doc")
    columns = ["area", "doc", "c", "sketch", "members"]
    place = F.xxhash64("doc")
    left = full.filter("c <> main").select(*columns, F.lit(0).alias("side"), F.pmod(place, F.col("nl")).cast("int").alias("li"),
                                           F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("rj"))
    right = full.select(*columns, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("li"),
                        F.pmod(place, F.col("nr")).cast("int").alias("rj")).select(left.columns)
    run, schema = _block_links(percent, most)
    return left.union(right).groupBy("area", "li", "rj").applyInArrow(run, schema)


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, bands: int = 32, rows: int = 5,
                    slack: float = 0.24, block: int = 1024) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    k = bands * rows
    most = most_differing(k, max(0.0, percent / 100 - slack))
    source = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    source = source.withColumn("mark", F.unhex(F.md5(F.col("text").cast("binary"))))  # tells texts of one doc_id apart
    run, schema = _signatures(words, bands, rows)
    signed = materialize(source.mapInArrow(run, schema), "odd-signed")
    # a class's node is a number of its own, fixed when the table is written; its label is its smallest doc_id
    classes = materialize(
        signed.filter("digest is not null and doc_id is not null").groupBy("digest")
        .agg(F.min(F.struct("doc_id", "mark")).alias("m"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
        .select("digest", F.col("m.doc_id").alias("doc"), F.col("m.mark").alias("mark"), "sketch", "keys")
        .withColumn("node", F.monotonically_increasing_id()), "odd-classes")
    member = classes.select("node", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    buckets = materialize(member.join(shared.select("key", "pivot"), "key").select("key", "node", "pivot"), "odd-buckets")
    run, schema = _sets_of(words)
    wanted = buckets.groupBy("node").agg(F.max(F.col("node") == F.col("pivot")).alias("pivot"))
    wanted = wanted.join(classes.select("node", F.col("doc").alias("doc_id"), "mark"), "node")
    texts = source.join(wanted, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    sets = materialize(texts.select("text", "node", "pivot").mapInArrow(run, schema), "odd-sets")
    sketches = classes.select("node", "sketch")
    stars = buckets.filter("node <> pivot").select("node", "pivot").distinct()
    best = (stars.join(sketches, "node")
            .join(sketches.select(F.col("node").alias("pivot"), F.col("sketch").alias("other")), "pivot")
            .withColumn("d", _differing("sketch", "other")).filter(F.col("d") <= most)
            .groupBy("node").agg(F.min(F.struct("d", "pivot")).alias("b"))
            .select(F.col("b.pivot").alias("u"), F.col("node").alias("v")))
    first = materialize(_verified(best, sets, percent), "odd-links")
    joined = components(first)
    placed = materialize(
        buckets.join(joined.withColumnRenamed("node", "u"), F.col("node") == F.col("u"), "left")
        .select("key", "node", F.coalesce("component", "node").alias("c")), "odd-placed")
    second = _rest(placed, sketches, sets, percent, most, block)
    linked = components(materialize(first.union(second), "odd-links"))
    grouped = classes.select("digest", "doc", "node").join(linked, "node", "left").select("digest", "doc", F.coalesce("component", "node").alias("g"))
    grouped = materialize(grouped, "odd-groups")
    labels = grouped.groupBy("g").agg(F.min("doc").alias("c"))
    placed_class = grouped.join(labels, "g").select("digest", "c")
    return (signed.select("doc_id", "n_shingles", "digest").join(placed_class, "digest", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
