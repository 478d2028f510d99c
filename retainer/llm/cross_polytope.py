"""Approximate nearest neighbours by cross-polytope hashing (operator 7).

A table turns unit vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and assigns each to the nearest signed axis.  A query visits the `probes` nearest axes of every
table; the vectors found there are ranked by their exact cosine.  Base rows and queries of a bucket are dealt
in blocks of bounded size, each of which returns a query's best classes only.

Equal vectors are one class that keeps its `k + 1` smallest ids, which is all a top-k can use.  Of an id with several
vectors each is a candidate of its own, with its own score, so the id may be returned more than once; as a query it gets the
nearest of all its vectors; none of an id's vectors is its own candidate.  Repeated rows count once.  A query that finds
fewer than `k` others is asked again at every axis of one table, which is exact, so small tables are complete.

With 64 dimensions, 10 tables and 12 of 128 axes, recall at 5 on the check tables is 0.989 (10 thousand vectors)
and 0.998 (51 thousand).  Unusable vectors (null, empty, zero, null or non-finite components) and null ids take no
part; vectors of other lengths are never compared.  Ties go to the smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retainer.llm.vectors import classes, cosine, matrix, usable
from retainer.llm.workspace import materialize


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """The pseudo-rotation of a table, after padding with zeros to a power of two."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([7, table, size]).choice([-1.0, 1.0], (3, size))
    for s in signs:
        y = hadamard(y * s)
    return y


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` nearest signed axes of each row, nearest first; axis i and -i are 2i and 2i + 1."""
    near = np.empty((len(y), 2 * y.shape[1]))
    near[:, 0::2], near[:, 1::2] = y, -y
    return np.argsort(-near, axis=1, kind="stable")[:, : min(probes, near.shape[1])]


def _hash(tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *ids, column = batch.columns
            length = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False))
            for dim in np.unique(length):
                rows = np.flatnonzero(length == dim)
                kept = column.take(pa.array(rows))
                x = matrix(kept, int(dim))
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                own = [c.take(pa.array(rows)) for c in ids]
                for t in range(tables):
                    found = axes(rotated(x, t), probes)
                    at = pa.array(np.repeat(np.arange(len(rows)), found.shape[1]))
                    n = found.size
                    yield pa.RecordBatch.from_arrays(
                        [*[c.take(at) for c in own], kept.take(at), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(found.ravel().astype(np.int32))],
                        names=["id", "rep", "second", "v", "dim", "t", "axis"])

    return run, "id long, rep long, second long, v array<double>, dim int, t int, axis int"


def _rank(k: int):
    def run(base: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(base) and len(queries):
            dim = base["dim"][0].as_py()
            b, q = matrix(base["v"], dim), matrix(queries["v"], dim)
            norm_b = b / np.abs(b).max(axis=1, keepdims=True)
            norm_b /= np.sqrt((norm_b * norm_b).sum(axis=1, keepdims=True))
            ids, own = base["id"].to_numpy(), queries["id"].to_numpy()
            rep, second, alone = base["rep"].to_numpy(), base["second"].fill_null(0).to_numpy(), base["second"].is_null().to_numpy()
            norm_q = q / np.abs(q).max(axis=1, keepdims=True)
            norm_q /= np.sqrt((norm_q * norm_q).sum(axis=1, keepdims=True))
            take, slack, step = min(len(b), k + 1), 1e-12 + dim * 1e-15, max(1, (4 << 20) // dim)
            for a in range(0, len(q), 256):
                near = norm_q[a : a + 256] @ norm_b.T
                near[(own[a : a + 256, None] == rep) & alone] = -np.inf      # no candidate but the query's own id
                last = np.partition(near, len(b) - take, axis=1)[:, len(b) - take]
                # every class that rounding or a tie could put in the last place, however many
                row, col = np.nonzero((near >= last[:, None] - slack) & (near > -np.inf))
                if not len(row):
                    continue
                exact = np.concatenate([cosine(q[a + row[i : i + step]], b[col[i : i + step]]) for i in range(0, len(row), step)])
                least = np.where(rep[col] == own[a + row], second[col], rep[col])
                order = np.lexsort((ids[col], least, -exact, row))
                row, col, exact, least = row[order], col[order], exact[order], least[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < take
                out[0].append(own[a + row[first]])
                out[1].append(ids[col[first]])
                out[2].append(least[first])
                out[3].append(exact[first])
        flat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.int64, np.float64), strict=True)]
        return pa.table(flat, names=["query_id", "node", "least", "score"])

    return run, "query_id long, node long, least long, score double"


def _found(base: DataFrame, queries: DataFrame, k: int, tables: int, probes: int, block: int) -> DataFrame:
    """Best classes of each query: query_id, node, least (smallest id but the query's), score, distinct."""
    run, schema = _hash(tables, 1)
    rows = base.select(F.col("node").alias("id"), "rep", "second", "v").mapInArrow(run, schema)
    run, schema = _hash(tables, probes)
    none = F.lit(None).cast("long")
    asked = queries.select("id", none.alias("rep"), none.alias("second"), "v").mapInArrow(run, schema)
    key = ["dim", "t", "axis"]
    # one row for each bucket, two numbers: its blocks of base rows and of queries
    many = (rows.groupBy(key).agg(F.count("*").alias("b")).join(asked.groupBy(key).agg(F.count("*").alias("q")), key)
            .select(*key, F.ceil(F.col("b") / block).cast("int").alias("nb"), F.ceil(F.col("q") / block).cast("int").alias("nq")))
    many = materialize(many, "polytope-buckets")
    place = F.xxhash64("id", "v")
    left = (rows.join(many, key).withColumn("i", F.pmod(place, F.col("nb")).cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nb", "nq"))
    right = (asked.join(many, key).withColumn("j", F.pmod(place, F.col("nq")).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb", "nq"))
    run, schema = _rank(k)
    blocks = [*key, "i", "j"]
    return left.groupBy(blocks).cogroup(right.groupBy(blocks)).applyInArrow(run, schema).groupBy("query_id", "node", "least").agg(F.max("score").alias("score"))


def _best(found: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The k nearest ids of each query."""
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "least", "node")
    first = found.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1).drop("n")
    ids = first.join(base.select("node", "ids"), "node").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ids.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = 10, probes: int = 12, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, embedding) among `vectors`, itself excepted."""
    base = materialize(classes(usable(vectors), k + 1), "polytope-classes")
    asked = materialize(usable(queries).dropDuplicates(["id", "v"]), "polytope-queries")
    found = materialize(_best(_found(base, asked, k, tables, probes, block), base, k), "polytope-found")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    short = materialize(asked.join(full, F.col("id") == F.col("query_id"), "left_anti"), "polytope-short")
    if not short.limit(1).count():
        return found
    again = _best(_found(base, short, k, 1, 1 << 30, block), base, k)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(again)
