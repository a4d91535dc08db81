"""Lists of URLs: text, CSV or TSV in any usual charset, or in a zip archive."""

from __future__ import annotations

import csv
import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.functions import urls

BARE = re.compile(r"[a-z0-9.-]+\.[a-z]{2,}(/\S*)?", re.IGNORECASE)


def decoded(data: bytes) -> str:
    """By byte order mark, else UTF-8, else CP949."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for charset in ("utf-8-sig", "cp949"):
        try:
            return data.decode(charset)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def unpacked(data: bytes) -> str:
    """The text of a list; of an archive the first member with addresses, such as are named for pages first."""
    if data[:4] != b"PK\x03\x04":
        return decoded(data)
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = [n for n in archive.namelist() if n.lower().endswith((".csv", ".txt"))]
        ordered = sorted(names, key=lambda n: not ("page" in n.lower() or "페이지" in n))
        return next((t for n in ordered if "http" in (t := decoded(archive.read(n)))), "")


def cells(text: str) -> list[str]:
    """The first column, by tabs if these outnumber commas, as addresses with a scheme."""
    start = text[:4096]
    rows = csv.reader(io.StringIO(text), delimiter="\t" if start.count("\t") > start.count(",") else ",")
    found = (row[0].strip().strip('"').strip() for row in rows if row)
    found = (c for c in found if c and not c.startswith("#"))
    return [c if c.lower().startswith(("http://", "https://")) else f"http://{c}" for c in found if re.match("https?://", c, re.I) or BARE.fullmatch(c)]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(list, ord, url): the distinct normalised URLs of each file, in the order of their first place."""
    return listed(spark.read.format("binaryFile").load(path).select("path", "content"))


def listed(files: DataFrame) -> DataFrame:
    """The same of a table of files: name, bytes."""

    def split(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = cells(unpacked(data.as_py() or b""))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())], ["list", "ord", "url"])

    raw = files.mapInArrow(split, "list string, ord long, url string")
    normal = raw.select("list", "ord", urls.normalized("url").alias("url")).where("url <> ''")
    return normal.groupBy("list", "url").agg(F.min("ord").alias("ord")).select("list", "ord", "url")
