"""Shared working folder and materialised intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a local one on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="retainer-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, *order: Column, name: str = "positions") -> DataFrame:
    """`df` with its exact 0-based position in the total order `order`.

    Rows are range-partitioned and sorted once and written; a row's position is its place in its
    partition plus the sizes of the partitions before it (one row per partition).  As the written rows
    carry both numbers, the result does not depend on how ranges were sampled.
    """
    wide = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = wide.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return (wide.withColumn("_part", part).join(F.broadcast(before), "_part")
            .withColumn("position", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
            .drop("_at", "_part", "_before"))


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns; names are matched exactly, so clashing extra columns do not matter."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the column's text form, modulo `divisor` (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)
