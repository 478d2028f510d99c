"""Customer-retention analytics as lazy Spark DataFrame operators.

Sub-packages:
  sources    readers, writers, contracts and the driver-table fixture views
  functions  column expressions (rules, flags, ratios, buckets)
  operators  DataFrame -> DataFrame operators (features, segments, models, ...)
  plans      the registered queries and their DuckDB oracle SQL
  streaming  the batch-scoring plan run as a Structured Streaming query
"""

from retainer.session import get_session, checkpoint_dir  # noqa: F401
