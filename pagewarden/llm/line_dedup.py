"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines is hashed (two independent 64-bit values). Windows are ranked over the
whole table by (id, position); a window equal to an earlier one is a later occurrence, and a line that any
later occurrence covers is removed. The first occurrence of every line survives: a window that would cover
it has an equal window still earlier, which would hold the same line.

Defined results: lines end at ``\\n`` only. Windows of three blank lines don't count. Texts of fewer than
three lines, empty and null texts stay as they are. Rows with equal id and text are one document: they get
the same result. Null ids rank first. All other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import SPACE_RUN, fresh, stored

SIZE = 3


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(h1, h2, id, twin, pos): one row per window; twin tells rows of equal id apart by their text."""
    lines = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("twin"), F.split(F.col(text_col), "\n").alias("lines")
    ).where(F.size("lines") >= size)
    at = lambda i, k: F.get("lines", i + k)
    full = lambda i: F.exists(F.slice("lines", i + 1, size), lambda x: F.length(F.regexp_replace(x, SPACE_RUN, "")) > 0)
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("lines") - size),
        lambda i: F.when(
            full(i),
            F.struct(
                F.xxhash64(*[at(i, k) for k in range(size)]).alias("h1"),
                F.xxhash64(F.lit(size), *[at(i, k) for k in reversed(range(size))]).alias("h2"),
            ),
        ),
    )
    rows = lines.select("id", "twin", F.posexplode(hashed).alias("pos", "h"))
    return rows.where("h is not null").select("h.h1", "h.h2", "id", "twin", "pos")


def later_occurrences(found: DataFrame) -> DataFrame:
    """(id, twin, starts): where each document repeats an earlier window."""
    place = F.struct("id", "twin", "pos")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(firsts.hint("merge"), ["h1", "h2"]).where(place > F.col("first"))
    return later.groupBy("id", "twin").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """The same rows with later occurrences removed from the text, and columns n_lines and n_removed."""
    starts = later_occurrences(stored(windows(docs, id_col, text_col, size), "windows"))
    a, b, c, lines, kept = (fresh(docs, f"_pw_{x}") for x in ("id", "twin", "starts", "lines", "kept"))
    n_lines, n_removed = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    starts = starts.toDF(a, b, c)
    joined = docs.join(starts, docs[id_col].eqNullSafe(starts[a]) & (F.xxhash64(docs[text_col]) == starts[b]), "left").drop(a, b)
    covered = F.flatten(F.transform(c, lambda i: F.sequence(i, i + size - 1)))
    whole = F.sequence(F.lit(0), F.size(lines) - 1)
    cut = (
        joined.withColumn(lines, F.split(F.col(text_col), "\n"))
        .withColumn(kept, F.when(F.col(c).isNotNull(), F.array_except(whole, covered)))
        .withColumn(n_lines, F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn(n_removed, F.coalesce(F.col(n_lines) - F.size(kept), F.lit(0)).cast("long"))
    )
    text = F.when(F.col(c).isNotNull(), F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return cut.select(*[F.coalesce(text, F.col(x)).alias(x) if x == text_col else x for x in docs.columns], n_lines, n_removed)
