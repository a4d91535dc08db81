"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

#: Paths that each application has written.
WRITTEN: dict[str, list[str]] = defaultdict(list)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder.

    The folder is the session's spark.checkpoint.dir; where that is unset, a local one, which only local mode allows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pagewarden-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    WRITTEN[spark.sparkContext.applicationId].append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table and read it back: what comes after it doesn't compute it again, even when executors are lost."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, keep: int = 0) -> int:
    """Delete the tables that this application has stored, but the first so many; returns how many went.

    Results that haven't been written yet read these tables, so this is for the end of a job or of a micro-batch.
    """
    paths = WRITTEN[spark.sparkContext.applicationId]
    gone, paths[keep:] = paths[keep:], []
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(gone)


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file to whatever store a path is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(data))
    out.close()
