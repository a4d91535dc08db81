"""Benchmark decontamination by size-partitioned MinHash containment search.

An item counts as contained in a document if at least ``threshold`` of the item's distinct five-word
shingles occur in it. Short items lie inside documents a thousand times their size, where the Jaccard
similarity is near zero and a banded signature of bearable length would miss most of them. So items are
partitioned by their number of distinct shingles, and the sketch of each class is the bottom-k MinHash with
k = n - ceil(threshold * n) + 1: a document that lacks all k sketch values lacks too many shingles, so the
search misses nothing. The document's side is the set of its own shingle hashes up to the largest sketch
value. Each candidate is verified by the item's shingles themselves.

Items are indexed and sent to the executors in blocks of a bounded number of bytes; each block is one pass over
the documents, so any number of items works.

Words are lower-cased and split at ASCII white space and punctuation; in scripts without spaces every character
is a word. An item of fewer than five words is one shingle, the whole of it. Ids are integers (cast to long).
Defined results: null and empty texts, and texts without words, contain nothing and, as items, match nothing.
Repeated rows are judged row by row; items that repeat an id are judged apart. Extra columns are ignored, or passed
through where rows are dropped.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import bounded_batches, filter_rows

SIZE = 5
THRESHOLD = 0.8
#: Bytes of item text in one block.
BLOCK_BYTES = 16 << 20
#: Words whose hashes, and items whose shingles, a worker remembers.
REMEMBERED, REMEMBERED_ITEMS = 1 << 19, 1 << 10
#: Odd multipliers that set the places of a shingle apart.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
TO_SPACE = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
#: Code points of scripts without spaces: Thai, Lao, Burmese, Khmer, Kana, Han.
UNSPACED = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
APART = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED) + "]")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    lowered = (text or "").lower()
    if not lowered.isascii():
        lowered = APART.sub(r" \g<0> ", lowered)
    return lowered.encode("utf-8", "surrogatepass").translate(TO_SPACE).split()


def mixed(ids: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of so many words, from the words' hashes."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ ids[k : k + n]) * PLACES[k % len(PLACES)]
        out ^= out >> np.uint64(29)
    return out


class Hasher:
    """Shingle hashes from remembered word hashes."""

    def __init__(self, size: int = SIZE):
        self.size, self.known = size, {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return mixed(self.ids(words), self.size) if len(words) >= self.size else np.empty(0, np.uint64)


class Table:
    """Sorted sketch values of the items whose shingles have one length, and which items have each."""

    def __init__(self, postings: dict[int, list[int]]):
        self.keys = np.array(sorted(postings), np.uint64)
        self.items = np.array([i for h in self.keys.tolist() for i in postings[h]], np.int32)
        self.ends = np.cumsum([0, *(len(postings[h]) for h in self.keys.tolist())])

    def candidates(self, hashes: np.ndarray) -> list[int]:
        found = hashes[hashes <= self.keys[-1]]
        places = np.searchsorted(self.keys, found)
        hits = np.unique(places[self.keys[places] == found]).tolist()
        return sorted({i for k in hits for i in self.items[self.ends[k] : self.ends[k + 1]].tolist()})


class Index:
    """The sketches of one block of items (id, text). Of the items' shingles only those at hand are kept."""

    def __init__(self, items: list[tuple], size: int = SIZE, threshold: float = THRESHOLD):
        hasher, self.items, self.shown = Hasher(size), [], {}
        classes: dict[tuple[int, int], list] = defaultdict(list)
        for item_id, text in items:
            if words := words_of(text):
                length = min(size, len(words))
                n = len({tuple(words[i : i + length]) for i in range(len(words) - length + 1)})
                classes[length, n].append((len(self.items), np.unique(mixed(hasher.ids(words), length))))
                self.items.append((item_id, text, length, n, math.ceil(threshold * n - 1e-9)))
        postings: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        for (length, n), members in classes.items():  # one sketch length for each size
            k = n - math.ceil(threshold * n - 1e-9) + 1
            for item, hashes in members:
                for h in hashes[:k].tolist():
                    postings[length][h].append(item)
        self.tables = {length: Table(p) for length, p in sorted(postings.items())}

    def __getstate__(self):
        return self.__dict__ | {"shown": {}}

    def shingles(self, item: int, hasher: Hasher) -> tuple[set, np.ndarray]:
        """An item's shingles and their hashes."""
        if item not in self.shown:
            if len(self.shown) >= REMEMBERED_ITEMS:
                self.shown.clear()
            _, text, length, *_ = self.items[item]
            words = words_of(text)
            self.shown[item] = {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}, np.unique(mixed(hasher.ids(words), length))
        return self.shown[item]

    def search(self, text: str | None, hasher: Hasher) -> Iterator[tuple]:
        """(item id, shingles of the item, shingles found) for each item that the text contains."""
        words = words_of(text)
        ids = hasher.ids(words)
        for length, table in self.tables.items():
            hashes = mixed(ids, length)
            if not len(hashes):
                continue
            for item in table.candidates(hashes):
                item_id, _, _, n, needed = self.items[item]
                wanted, own = self.shingles(item, hasher)
                places = np.flatnonzero(own[np.minimum(np.searchsorted(own, hashes), len(own) - 1)] == hashes)
                _, first = np.unique(hashes[places], return_index=True)
                shared = len(wanted & {tuple(words[p : p + length]) for p in places[first].tolist()})
                if shared >= needed:
                    yield item_id, n, shared


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items, a bounded number of bytes at a time."""
    block, held = [], 0
    for row in items.select(F.col(id_col).cast("long"), text_col, F.octet_length(text_col)).toLocalIterator():
        block.append((row[0], row[1]))
        held += (row[2] or 0) + 100
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    yield block


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, item, n_shingles, n_shared): every document and item that it contains."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = None
    for block in blocks(items, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(Index(block, size, threshold))

        def search(batches, sent=sent):
            index, hasher = sent.value, Hasher(size)
            for batch in batches:
                out = [(i.as_py(), *hit) for i, t in zip(batch.column(0), batch.column(1)) for hit in index.search(t.as_py(), hasher)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

        part = rows.mapInArrow(search, "id long, item long, n_shingles long, n_shared long")
        found = part if found is None else found.unionAll(part)
    return found


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    size: int = SIZE, threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows that contain no item, with all columns; each block of items filters in turn."""

    def keeps(index):
        hasher = Hasher(size)
        return lambda text: next(index.search(text, hasher), None) is None

    for block in blocks(items, item_col, item_text_col):
        docs = filter_rows(docs, text_col, docs.sparkSession.sparkContext.broadcast(Index(block, size, threshold)), keeps)
    return docs
