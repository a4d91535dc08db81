"""Files of trusted domains: a domain a line, ``#`` for comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.functions.domains import cleaned

#: A list of trusted domains is part of the plan, so it may have so many at most.
MOST = 100_000


def read(spark: SparkSession, path: str) -> list[str]:
    """The distinct domains of files, cleaned, sorted."""
    rows = spark.read.text(path).select(cleaned(F.col("value")).alias("domain")).where("domain <> ''").distinct()
    found = [r.domain for r in rows.limit(MOST + 1).collect()]
    if len(found) > MOST:
        raise ValueError(f"{path} has more than {MOST} domains")
    return sorted(found)


def write(domains: DataFrame, path: str) -> None:
    """Write a table (domain) as one file of cleaned lines."""
    rows = domains.select(cleaned(F.col("domain")).alias("value")).where("value <> ''").distinct().orderBy("value")
    rows.coalesce(1).write.mode("overwrite").text(path)
