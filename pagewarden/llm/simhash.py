"""SimHash near-duplicates by multi-index hashing.

A text's 64-bit fingerprint is the bitwise majority over the XXH64 values of its word shingles.
Fingerprints are cut into segments; two fingerprints that differ in at most ``radius`` bits agree up to
``radius // segments`` bits in one segment at least. So each fingerprint probes, per segment, every value
of that small Hamming ball against a table of the segments as they are, and each match is verified on the
whole 64 bits within the join. All of this works on distinct fingerprints, so copies are one node.

Ids are integers (cast to long). Defined results: a null or empty text has fingerprint zero, linked like any
other. Null ids are kept as rows, link like any other and take no part in a component's smallest id, which is
null where there is none. Rows that repeat an id are linked through it. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import bounded_batches, stored
from pagewarden.llm.groups import connected, one_of_each

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, len(starts), CHUNK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], stops[k : k + CHUNK])]
        octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, BITS // 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long."""
    bounded_batches(docs.sparkSession)

    def hashed(batches):
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(hashed, "id long, fp long")


def ball(width: int, radius: int) -> list[int]:
    """Masks of all values of so many bits with at most ``radius`` of them set."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def signed(value: int) -> int:
    """64 bits as a signed long."""
    return value - (1 << 64) if value >> 63 else value


def links(fps: DataFrame, radius: int = 3, segments: int = 2) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in at most ``radius`` bits."""
    distinct = fps.select("fp").distinct()
    width = BITS // segments
    parts = [
        F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit(signed((1 << width) - 1))).alias("value"))
        for s in range(segments)
    ]
    index = distinct.select(F.col("fp").alias("b"), F.inline(F.array(*parts)))
    masks = F.array(*[F.lit(signed(m)).cast("long") for m in ball(width, radius // segments)])
    probes = distinct.select(F.col("fp").alias("a"), F.inline(F.array(*parts))).select(
        "a", "segment", F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value")
    )
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return probes.join(index.hint("merge"), ["segment", "value"]).where(near).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, segments: int = 2
) -> DataFrame:
    """(id, fp, component) per row: the fingerprint and the smallest id among all rows that links reach."""
    fps = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
    return connected(fps, links(fps, radius, segments), fps.count())


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component, that of the smallest id, with all columns; see ``groups.one_of_each``."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col, **how), id_col)
