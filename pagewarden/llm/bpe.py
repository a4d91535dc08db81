"""Byte-level BPE encoding and decoding.

Texts are cut into words by the tokenizer's pattern. Each task encodes a distinct word once: the word starts
as single bytes, and the leftmost adjacent pair of lowest rank is merged until no pair has a rank. The ranks
are a literal map sent to all executors (its size is the vocabulary's). Decoding concatenates the binary
pieces of the ids. What a task remembers is bounded by ``REMEMBERED`` words.

``native_ids`` is the same fold in Spark's higher-order functions, for tables of words; the README says why
whole corpora don't go through it.

Ids are kept as little-endian unsigned 32-bit integers in a binary column. Defined results: null is encoded
like the empty text, to no ids. Special tokens are ordinary text. Extra columns are ignored; repeated rows
and ids get a row each.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from array import array
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import bounded_batches

REMEMBERED = 1 << 18
#: Words of more bytes are merged with a heap.
LONG = 64
BUCKETS = 1 << 15
NO_RANK = 1 << 32


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of a word."""
    if word in ranks:
        return [word]
    if len(word) > LONG:
        return merge_long(word, ranks)
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs and (best := min(pairs)) < NO_RANK:
        at = pairs.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = get(parts[at] + parts[at + 1], NO_RANK)
        if at:
            pairs[at - 1] = get(parts[at - 1] + parts[at], NO_RANK)
    return parts


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same in n log n steps: a heap of pairs over a linked list of pieces."""
    n = len(word)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, ends[j]))

    for i in range(n):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j < n and ends[j] == end:
            ends[i], after[i], alive[j] = end, after[j], False
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
    return [word[i : ends[i]] for i in range(n) if alive[i]]


class Codec:
    """Encodes and decodes with the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.pieces = {r: p for p, r in ranks.items()}
        self.packed = {p: r.to_bytes(4, "little") for p, r in ranks.items()}
        self.known: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        known, words = self.known, self.words(text or "")
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = b"".join([self.packed[p] for p in merge(w.encode(), self.ranks)])
        return b"".join(map(known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, array("I", ids)))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids) per row; and the bytes that decoding the ids gives, if asked for."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ranks_of(path))

    def coded(batches):
        codec = Codec(sent.value, pattern)
        for batch in batches:
            ids = [codec.encode(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(map(codec.decode, ids), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(coded, "id long, ids binary" + ", decoded binary" * decoded)


def decode(rows: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) per row of ids; null ids decode to nothing."""
    bounded_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(ranks_of(path))

    def pieced(batches):
        codec = Codec(sent.value, "x")
        for batch in batches:
            found = pa.array([codec.decode(x.as_py() or b"") for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(pieced, "id long, decoded binary")


def rank_buckets(path: str) -> Column:
    """The ranks as one literal that Catalyst folds: an array of hash buckets of (piece, rank)."""
    buckets: list[list] = [[] for _ in range(BUCKETS)]
    for piece, rank in ranks_of(path).items():
        buckets[zlib.crc32(piece) % BUCKETS].append({"p": base64.b64encode(piece).decode(), "r": rank})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<p:binary,r:int>>>")


def native_ids(word: Column, path: str) -> Column:
    """The ids of a word, an array of integers, in higher-order functions alone."""
    buckets, word = rank_buckets(path), word.cast("binary")

    def rank(piece: Column) -> Column:
        found = F.filter(F.get(buckets, (F.crc32(piece) % BUCKETS).cast("int")), lambda e: e["p"] == piece)
        return F.get(found, F.lit(0))["r"]

    def ranked(parts: Column) -> Column:
        places = F.when(F.size(parts) > 1, F.sequence(F.lit(0), F.size(parts) - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: rank(F.concat(F.get(parts, i), F.get(parts, i + 1))))

    def step(state: Column, _: Column) -> Column:
        best = F.array_min(state["ranks"])
        at = F.array_position(state["ranks"], best).cast("int") - 1
        joined = F.concat(F.get(state["parts"], at), F.get(state["parts"], at + 1))
        parts = F.concat(F.slice(state["parts"], 1, at), F.array(joined), F.slice(state["parts"], at + 3, F.size(state["parts"])))
        return F.when(best.isNull(), state).otherwise(F.struct(parts.alias("parts"), ranked(parts).alias("ranks")))

    single = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    start = F.struct(single.alias("parts"), ranked(single).alias("ranks"))
    pieces = F.aggregate(single, start, step, lambda s: s["parts"])
    return F.when(F.length(word) > 0, F.transform(pieces, rank)).otherwise(F.array().cast("array<int>"))
