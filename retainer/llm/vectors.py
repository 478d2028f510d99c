"""Shared handling of embedding tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retainer.llm.workspace import only


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v) of the vectors with a direction: not null, not empty, not zero, all components finite; id not null."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (only(vectors, id_column, column).select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
            .filter(F.col("id").isNotNull() & v.isNotNull()).filter(~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """One row for each distinct vector: v, its `keep` smallest ids, ascending, the first two of them (rep, second; null if
    there is one) and `node`, a number of its own that holds once the table is written.

    Only the first ids of a vector leave a task, so a vector that many rows share stays small.
    """
    first = Window.partitionBy("v").orderBy("id")
    return (rows.dropDuplicates(["id", "v"]).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= keep)
            .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
            .select(F.monotonically_increasing_id().alias("node"), F.col("ids")[0].alias("rep"), F.try_element_at("ids", F.lit(2)).alias("second"), "v", "ids"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
