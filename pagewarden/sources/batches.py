"""Bounded Arrow batches for stages that hand whole pages and texts to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes that a Python worker receives at once; a longer row travels alone.
ROWS, BYTES = 256, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds to these; smaller ones stay. They are read when a plan runs, so they aren't set back."""
    for key, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").removesuffix("b")
        if not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)
