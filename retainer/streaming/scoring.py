"""Batch scoring (G1) as a Structured Streaming query.

``score_batch`` holds no action, so the same plan scores a stream of JSON
records: file (or any text) source -> ``parse_records`` -> ``score_batch``
-> append to a Parquet sink.  The checkpoint location lives under the
shared checkpoint folder so a restarted driver or lost executors resume
from the last committed micro-batch.  A running risk roll-up keeps its
state in the state store, keyed by (segment, risk level) -- at most 16 keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retainer.operators import batch as B
from retainer.session import scratch_path
from retainer.sources import files as IO


def record_stream(spark: SparkSession, source_dir: str, max_files: int = 100) -> DataFrame:
    """JSON-lines files arriving in ``source_dir`` -> typed scoring records."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(source_dir)
    return IO.parse_records(raw, "value")


def scored_stream(spark: SparkSession, source_dir: str, scorer=None) -> DataFrame:
    """Records must carry CustomerId (a stream has no global order for A10)."""
    return B.score_batch(record_stream(spark, source_dir), scorer)


def start_scoring(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str | None = None,
                  scorer=None, trigger_once: bool = False) -> StreamingQuery:
    """Append scored rows to Parquet at ``sink_dir``."""
    ck = checkpoint or scratch_path(spark, "stream-scoring")
    w = (scored_stream(spark, source_dir, scorer).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", ck).outputMode("append"))
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()


def risk_rollup(scored: DataFrame) -> DataFrame:
    """Running count and mean probability per (segment, risk level)."""
    return scored.groupBy("Segment", "RiskLevel").agg(
        F.count(F.lit(1)).alias("count"), F.avg("ChurnProbability").alias("avg_probability"))


def start_rollup(spark: SparkSession, source_dir: str, table: str, checkpoint: str | None = None,
                 trigger_once: bool = False) -> StreamingQuery:
    """Keep the roll-up in a memory table (tests) -- ``complete`` mode."""
    ck = checkpoint or scratch_path(spark, "stream-rollup")
    w = (risk_rollup(scored_stream(spark, source_dir)).writeStream.format("memory").queryName(table)
         .option("checkpointLocation", ck).outputMode("complete"))
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()
