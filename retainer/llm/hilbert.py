"""Sharding along a Hilbert curve over metadata dimensions (operator 5).

Source, language and size are quantised to cells of `BITS` bits each: levels of source and language by the share of rows
in more frequent levels (levels beyond the `LEVELS` most frequent have the last cell), size by its power of two; rows are ordered by the index of their cell on a three-dimensional Hilbert curve and the order is cut into
runs of equal row counts.  Neighbouring cells stay together, so a shard covers a compact region of all
dimensions and its cell ranges (`manifest`) let readers skip it: `write` stores a folder for each shard and
`read_within` opens only those whose ranges meet the wanted cells.

The law is `rows`: counts differ by one at most.  Ties on the curve go by text hash, so equal texts with equal
metadata are neighbours, then by doc_id.  A hot cell is cut like any other run.  The text itself is not shuffled.

Nulls: a null text has size 1 and text_crc32 0; null metadata has cell 0; a null doc_id sorts first.  Repeated
rows get a slot each.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retainer.llm.workspace import only, positions

BITS = 5

#: Levels of a text column that are ranked; their table is broadcast.
LEVELS = 4096

CELLS = ("source_cell", "lang_cell", "size_cell")


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of `cells` (points x dimensions, values below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotations of the larger cubes
        bit, below = 1 << level, (1 << level) - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            x[i] ^= np.where(high, 0, swap) if i else 0
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    index = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> level) & 1)
    return index


@F.pandas_udf(T.LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a, b, c], axis=1)) if len(a) else [], dtype="int64")


def levels(docs: DataFrame, column: str) -> DataFrame:
    """(level, cell) of the `LEVELS` most frequent values of a text column: the share of rows in levels before it, ties by name."""
    counts = docs.select(F.col(column).cast("string").alias("level")).filter("level is not null").groupBy("level").agg(F.count("*").alias("n"))
    order = [F.col("n").desc(), F.col("level")]
    top = counts.orderBy(*order).limit(LEVELS)
    total = counts.agg(F.sum("n").alias("total"))
    before = F.sum("n").over(Window.orderBy(*order)) - F.col("n")  # at most LEVELS rows
    return (top.withColumn("before", before).join(F.broadcast(total))  # one row
            .select("level", F.expr(f"cast(before * {1 << BITS} div total as int)").alias("cell")))


def with_cell(rows: DataFrame, docs: DataFrame, column: str, cell: str) -> DataFrame:
    """Adds the cell of a text column; null has cell 0, which the most frequent level shares."""
    named = levels(docs, column).select(F.col("level").alias("_level"), F.col("cell").alias("_cell"))
    found = rows.join(F.broadcast(named), F.col(column).cast("string") == F.col("_level"), "left")
    value = F.when(F.col(column).isNull(), 0).otherwise(F.coalesce("_cell", F.lit((1 << BITS) - 1)))
    return found.withColumn(cell, value).drop("_level", "_cell")


def size_cell(size: Column) -> Column:
    """Cell of a positive number: its power of two."""
    return F.least(F.floor(F.log2(size)), F.lit((1 << BITS) - 1)).cast("int")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row, and source_cell, lang_cell, size_cell, curve."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    source = only(docs, "doc_id", "text", "lang", "source")
    cells = (source.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                           F.crc32(raw).alias("text_crc32"), "source", "lang")
             .withColumn("size_cell", size_cell(F.col("size"))))
    for column in ("source", "lang"):
        cells = with_cell(cells, source, column, f"{column}_cell")
    cells = cells.drop("source", "lang")
    placed = positions(cells.withColumn("curve", _curve("source_cell", "lang_cell", "size_cell")),
                       F.col("curve"), F.col("text_crc32"), F.col("doc_id"), F.col("size"), name="hilbert")
    n = placed.count()
    number = F.expr(f"cast(position * {shards} div {max(1, n)} as int)")
    first = F.expr(f"(shard * {max(1, n)}L + {shards - 1}) div {shards}")
    return (placed.withColumn("law", F.lit("rows")).withColumn("shard", number).withColumn("slot", F.col("position") - first)
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                    "source_cell", "lang_cell", "size_cell", "curve"))


def manifest(sharded: DataFrame) -> DataFrame:
    """Row count and cell ranges of each shard, for pruning."""
    ranges = [f(c).alias(f"{n}_{c}") for c in CELLS for f, n in ((F.min, "min"), (F.max, "max"))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges)


def write(sharded: DataFrame, path: str) -> None:
    """Stores the rows, a folder for each shard in the order of its slots, the manifest, and the columns (no rows)."""
    sharded.limit(0).write.parquet(f"{path}/columns")
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/rows")
    manifest(sharded.sparkSession.read.schema(sharded.schema).parquet(f"{path}/rows")).write.parquet(f"{path}/manifest")


def read_within(spark: SparkSession, path: str, **cells: tuple[int, int]) -> DataFrame:
    """Stored rows whose named cells lie between the given ends, both included; files of other shards are not opened."""
    ranges = spark.read.parquet(f"{path}/manifest")
    for name, (low, high) in cells.items():
        ranges = ranges.filter((F.col(f"max_{name}") >= low) & (F.col(f"min_{name}") <= high))
    wanted = sorted(r["shard"] for r in ranges.select("shard").collect())  # a row a shard
    rows, columns = f"{path}/rows", spark.read.parquet(f"{path}/columns")
    found = spark.read.schema(columns.schema).option("basePath", rows).parquet(*[f"{rows}/shard={n}" for n in wanted]) if wanted else columns
    found = found.select(columns.columns)  # the folder's name is read last
    for name, (low, high) in cells.items():
        found = found.filter(F.col(name).between(low, high))
    return found
