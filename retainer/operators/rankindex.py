"""G9 + G12: a ranked result written once, so that a page or a filter opens few blocks.

Rows are placed along the ranking (descending probability, ties by id) and written in blocks of consecutive
ranks, one folder a block.  The manifest has one row for each block, risk level and segment: how many rows, and the
range of their probabilities.  A page is found by adding up the manifest's counts; only the blocks
that hold its rows are read, however deep the page lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retainer.operators.batch import rank_order
from retainer.operators.stats import row_positions

ROWS = 100_000      # rows of a block
_GROUP = ["RiskLevel", "Segment"]


def write_ranked(results: DataFrame, path: str, rows: int = ROWS) -> None:
    """Blocks under ``path``/blocks, the manifest under ``path``/manifest, the schema under ``path``/columns; ``results`` has unique ids."""
    ranked = row_positions(results, rank_order(), "_pos")
    ranked = ranked.withColumn("rank", F.col("_pos") + 1).withColumn("block", F.floor(F.col("_pos") / rows).cast("bigint")).drop("_pos")
    ranked.repartition("block").sortWithinPartitions("block", "rank").write.partitionBy("block").parquet(f"{path}/blocks")
    ranked.limit(0).write.parquet(f"{path}/columns")
    spark = results.sparkSession
    (_blocks(spark, path).groupBy("block", *_GROUP)
     .agg(F.count(F.lit(1)).alias("n"), F.min("ChurnProbability").alias("lo"), F.max("ChurnProbability").alias("hi"))
     .coalesce(1).write.parquet(f"{path}/manifest"))


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/blocks")


def _wanted(risk: str | None, segment: str | None) -> Column:
    keep = F.lit(True)
    for column, value in zip(_GROUP, (risk, segment), strict=True):
        keep = keep & (F.col(column) == value) if value is not None else keep
    return keep


def page_blocks(spark: SparkSession, path: str, page: int = 1, per_page: int = 5,
                risk: str | None = None, segment: str | None = None) -> tuple[list[int], int, int]:
    """The blocks that hold a page of the filtered ranking, how many filtered rows come before the first
    of them, and how many there are in all.  At most ``per_page`` blocks: each has a row of the page."""
    per = (spark.read.parquet(f"{path}/manifest").where(_wanted(risk, segment)).groupBy("block").agg(F.sum("n").alias("n")))
    ends = per.withColumn("end", F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))   # one row a block
    first, last = (page - 1) * per_page, page * per_page
    hit = ends.where((F.col("end") > first) & (F.col("end") - F.col("n") < last)).orderBy("block").collect()
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return [r["block"] for r in hit], (hit[0]["end"] - hit[0]["n"] if hit else 0), total


def read_page(spark: SparkSession, path: str, page: int = 1, per_page: int = 5, risk: str | None = None, segment: str | None = None,
              columns: Sequence[str] = ("CustomerId", "Segment", "ChurnProbability", "RiskLevel")) -> DataFrame:
    """One page of the (filtered) ranking: rank among the filtered rows, ``columns``, total_pages.  A page
    beyond the last has no rows."""
    blocks, before, total = page_blocks(spark, path, page, per_page, risk, segment)
    rows = _blocks(spark, path).where(F.col("block").isin(blocks) if blocks else F.lit(False)).where(_wanted(risk, segment))
    place = F.row_number().over(Window.orderBy("rank")) + F.lit(before)          # rows of the page's blocks only
    placed = rows.withColumn("_place", place).where((F.col("_place") > (page - 1) * per_page) & (F.col("_place") <= page * per_page))
    return placed.select(F.col("_place").cast("bigint").alias("rank"), *columns, F.lit(-(-total // per_page)).cast("bigint").alias("total_pages"))


def read_range(spark: SparkSession, path: str, low: float, high: float, risk: str | None = None, segment: str | None = None) -> DataFrame:
    """Rows with ``low`` <= probability <= ``high`` (and the filters), read from the blocks whose range meets it."""
    meets = (F.col("hi") >= low) & (F.col("lo") <= high)
    held = spark.read.parquet(f"{path}/manifest").where(_wanted(risk, segment) & meets).agg(F.min("block").alias("a"), F.max("block").alias("b")).first()
    inside = F.col("block").between(held["a"], held["b"]) if held["a"] is not None else F.lit(False)
    return _blocks(spark, path).where(inside & _wanted(risk, segment) & F.col("ChurnProbability").between(low, high)).drop("block")
