"""Arrow UDFs that run once for each row, in bounded batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pagewarden.sources.batches import bounded_batches


def once(udf):
    """A UDF whose value is worked out once for each row, whatever is filtered by it or read from it.

    To the optimizer it is nondeterministic. It would else copy the call into each filter on its result, and every copy takes a
    Python worker of its own for each task. Each place where a column of it is written is a call, so an expression names it once.
    """
    if (session := SparkSession.getActiveSession()) is not None:
        bounded_batches(session)
    return udf.asNondeterministic()
