"""The corpus pipeline: documents to training tokens in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. Stages but the
last return the columns of documents, whatever further columns there are.

Defined results: the first stage drops null, empty and letterless texts; the later ones take them too, as their
operators do: cutting lines leaves them as they are, they are near duplicates of each other, contain no benchmark
item and have no tokens. Of rows that repeat an id the near-duplicate stage keeps one; rows with a null id pass
through it. Very long texts are worked on whole. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm import bpe, decontaminate, langid, line_dedup, neardup
from pagewarden.llm.catalog import language_model
from pagewarden.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those of which languages make up less than a quarter: random characters, unknown scripts."""
    return langid.keep_identified(docs, language_model(docs))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later occurrences of three-line windows; drop documents of which nothing is left."""
    cut = line_dedup.dedup_lines(docs)
    lines, removed = cut.columns[-2:]
    left = cut.where((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    n_chars = F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return left.select(*[n_chars if c == "n_chars" else c for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates: SimHash, checked by the Jaccard similarity of
    five-word shingles, 0.8 or more, and what lies outside its radius by prefix filtering."""
    return neardup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return found.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode_tokens),
]

#: Language identification and compression have no SQL form; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
