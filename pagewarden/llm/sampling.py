"""Bounded, deterministic samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Only the share of each label's rows that holds so many times the wanted rows on average is looked at, whatever the input's size.
SPARE = 4


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_label: int, bytes_per_label: int) -> list[tuple]:
    """(id, text, label) of a sample of documents (id, text) with labels (id, label), sorted by label, then by hash of the id.

    Of each label, however many there are, come the first ``rows_per_label`` rows by the hash of their id, as far
    as their whole texts fit into ``bytes_per_label`` (a longer one is passed over). Only keys and lengths of the
    drawn share are joined, and no label's rows meet in one task; texts are fetched for the chosen rows alone. Null
    ids, texts or labels are never chosen; of several labels of an id the largest holds, repeated rows are one.
    """
    keys = docs.select("id", F.octet_length("text").alias("size")).where("id is not null and size is not null")
    labels = labels.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    labels = labels.withColumn("h", F.xxhash64(F.col("id").cast("string"), F.lit("sample")))
    share = labels.groupBy("label").agg((F.lit(float(SPARE * rows_per_label)) / F.count("*")).alias("share"))
    drawn = labels.join(F.broadcast(share), "label").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    rows = keys.join(drawn, "id").distinct().collect()
    chosen, held, taken = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r.h, r.id, r.size)):
        if taken.get(r.label, 0) < rows_per_label:
            taken[r.label] = taken.get(r.label, 0) + 1
            if held.get(r.label, 0) + r.size <= bytes_per_label:
                held[r.label] = held.get(r.label, 0) + r.size
                chosen[r.id, r.size] = r.label, r.h
    if not chosen:
        return []
    kind = StructType([keys.schema["id"], StructField("size", IntegerType())])
    wanted = F.broadcast(docs.sparkSession.createDataFrame(sorted(chosen), kind))
    texts = docs.select("id", "text", F.octet_length("text").alias("size")).join(wanted, ["id", "size"], "left_semi").distinct()
    found = [(r.id, r.text, *chosen[r.id, r.size]) for r in texts.collect()]
    return [r[:3] for r in sorted(found, key=lambda r: (str(r[2]), r[3], r[0], r[1]))]
