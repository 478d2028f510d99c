"""Rows of conversations in their exact order, with no window over a whole conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainer.llm.workspace import materialize, only

#: Stands for a null in the keys of a conversation.
BLANK = " "


def typed(conversations: DataFrame) -> DataFrame:
    """conv_id and turn as long, role and text as string; other columns go."""
    return only(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))


def key(column: str = "conv_id") -> Column:
    """The decimal text of a number, one space for null: a key that joins nulls too."""
    return F.coalesce(F.col(column).cast("string"), F.lit(BLANK))


def sequenced(rows: DataFrame, carry: dict[str, Column], name: str) -> DataFrame:
    """The columns `carry` of `rows` (conv_id, turn, role, text) with `seq`, which grows along (conv_id, turn, role, text), nulls first.

    Rows are range-partitioned, sorted and written once.  A long conversation is spread over partitions, and so are
    equal rows, whose order does not matter.  `seq` is increasing, not gapless; its upper bits are the partition.
    """
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"), F.asc("_copy")]
    sorted_rows = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(sorted_rows.select(*[c.alias(n) for n, c in carry.items()], F.monotonically_increasing_id().alias("seq")), name)


def numbered(rows: DataFrame, conv: str = "conv") -> DataFrame:
    """`rows` (conv, seq, ...) with `idx`, the 0-based place of a row in its conversation.

    Places are counted within (partition, conversation).  Only the first conversation of a partition can have rows in
    earlier ones, so what is added to places comes from a table of at most one row a partition.
    """
    part = F.shiftright("seq", 33)
    runs = rows.groupBy(part.alias("_part"), F.col(conv).alias("_conv")).agg(F.count("*").alias("n"), F.min("seq").alias("_first"))
    edges = runs.groupBy("_part").agg(F.min_by(F.struct("_conv", "n"), "_first").alias("head"), F.max_by(F.struct("_conv", "n"), "_first").alias("tail"))
    across = Window.orderBy("_part")  # one row a partition
    tail, head = F.col("tail"), F.col("head")
    before = (edges.withColumn("_until", F.sum(F.when(head["_conv"] == tail["_conv"], F.lit(0)).otherwise(F.lit(1))).over(across))
              .withColumn("_prev", F.lag("tail").over(across))
              .withColumn("_new", F.when(F.col("_prev._conv") == head["_conv"], 0).otherwise(1)))
    # a run of partitions that one conversation goes on through: its sizes are summed from where it begins
    before = before.withColumn("_chain", F.sum(F.col("_new")).over(across) + F.lag("_until", 1, 0).over(across))
    chained = Window.partitionBy("_chain").orderBy("_part")
    before = before.withColumn("_add", F.coalesce(F.sum(F.when(F.col("_new") == 0, F.col("_prev.n")).otherwise(F.lit(0))).over(chained), F.lit(0)))
    before = before.filter("_add > 0").select(F.col("_part").alias("_at"), F.col("head._conv").alias("_head"), "_add")
    place = F.row_number().over(Window.partitionBy("_part", conv).orderBy("seq")) - 1
    return (rows.withColumn("_part", part).withColumn("_place", place.cast("long"))
            .join(F.broadcast(before), (F.col("_part") == F.col("_at")) & (F.col(conv) == F.col("_head")), "left")
            .withColumn("idx", F.col("_place") + F.coalesce("_add", F.lit(0)))
            .select(*[F.col(c) for c in rows.columns], "idx"))
