"""What the corpus operators share: tables, the shared folder, bounded Arrow batches, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a Python worker receives at once; a longer text travels alone.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20
#: A side is broadcast only if its rows, counted first, take less than this in a hash table.
BROADCAST_BYTES = 64 << 20
#: Bytes of a row of one or two numbers in such a table.
NARROW_ROW = 64
#: A bitmap of marked keys has two to the power of this many bits at most, however many keys there are, and about so many bits a key if that is less.
BITMAP = 28
BITS_PER_KEY = 128
#: Rows of a narrow table in a file.
ROWS_PER_FILE = 200_000

#: Splits as `[^\x20\x09-\x0D]+` does, for Java regular expressions.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of the session's Python stages small, so that long texts don't add up.

    The bounds are read when a plan runs, so they stay in the session; smaller ones are left as they are.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").removesuffix("b")
        if not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Where that is unset, a temporary folder of this machine takes its place, which only local mode allows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagewarden-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths that each application has written to the shared folder.
WRITTEN: dict[str, list[str]] = defaultdict(list)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    WRITTEN[spark.sparkContext.applicationId].append(path)
    return path


def forget(spark: SparkSession) -> int:
    """Delete what this application has stored; returns how many paths.

    Results that haven't been written yet read these tables, so this is for the end of a job.
    """
    paths = WRITTEN.pop(spark.sparkContext.applicationId, [])
    delete(spark, paths)
    return len(paths)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, in whatever store they are."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(spark: SparkSession, *but: str):
    """Tables stored within are deleted at the end, all but those of these labels."""
    written = WRITTEN[spark.sparkContext.applicationId]
    start = len(written)
    try:
        yield
    finally:
        gone = [p for p in written[start:] if p.rpartition("/")[2].rpartition("-")[0] not in but]
        written[start:] = [p for p in written[start:] if p not in gone]
        delete(spark, gone)


@contextmanager
def tidied(spark: SparkSession):
    """Shuffle files of a plan that runs within go once it has ended, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    Of a narrow table of at most so many ``rows`` the files are as many as these fill, not as many as there are
    shuffle partitions.
    """
    path = scratch(df.sparkSession, label)
    (df if rows is None else df.coalesce(1 + rows // ROWS_PER_FILE)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def remainder(column: Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo a divisor; null for null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(divisor))


def filter_rows(docs: DataFrame, text_col: str, sent, keeps) -> DataFrame:
    """The rows whose text passes ``keeps(value)``, a function that makes a predicate of a broadcast value.

    Rows go through Arrow with all of their columns, so nothing is joined or shuffled.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def filtered(batches):
        import pyarrow as pa

        keep = keeps(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([keep(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(filtered, docs.schema)


def fits(rows: int, row_bytes: int = NARROW_ROW) -> bool:
    """Whether a side of so many rows may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def without(docs: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The rows whose value isn't in a stored one-column table; rows with a null stay."""
    gone = gone.toDF("_gone")
    if fits(gone.count()):
        gone = F.broadcast(gone)
    return docs.join(gone, docs[column] == gone["_gone"], "left_anti")


def bitmap(keys: DataFrame) -> np.ndarray:
    """Marks the hashes of a one-column table in a bitmap of a bounded size.

    Tasks put bits together to words, so the driver gets the bitmap and never the keys. ``marked`` is true for
    every key and for few other hashes, the more of these the more keys there are. Few keys make a small bitmap: every
    executor and the driver keep it on disk while it is in use.
    """
    places = keys.select(F.shiftrightunsigned(F.col(keys.columns[0]), 64 - BITMAP).alias("place"))
    bits = places.selectExpr("cast(shiftright(place, 6) AS int) AS word", "shiftleft(1L, cast(place & 63 AS int)) AS bit")
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words, values = found["word"].to_numpy().astype(np.int64), found["bits"].to_numpy().view(np.uint64)
    enough = (BITS_PER_KEY * int(np.bitwise_count(values).sum())).bit_length()
    out = np.zeros(1 << (min(BITMAP, max(6, enough)) - 6), np.uint64)
    if len(words) and enough < BITMAP:
        for k in range(64):
            place = (words[values >> np.uint64(k) & np.uint64(1) == 1] * 64 + k) >> (BITMAP - enough)
            np.bitwise_or.at(out, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    else:
        out[words] = values
    return out


def marked(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the hashes (64 bits each) are marked."""
    place = hashes.view(np.uint64) >> np.uint64(64 - (64 * len(bits)).bit_length() + 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
