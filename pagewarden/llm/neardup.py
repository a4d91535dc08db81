"""Near duplicates by the exact Jaccard similarity of word shingles: operator 10 where a similarity is asked for.

Two texts are linked if their sets of distinct five-word shingles have a Jaccard similarity of ``threshold`` or
more. SimHash comes first: fingerprints that multi-index hashing links (``simhash``, with its own settings) name
pairs, and those that reach the threshold are connected. Such fingerprints find about a fifth of the links, so
prefix filtering follows for the rest and misses nothing: with all shingles in one order, two such sets
share a shingle among the first n - ceil(threshold * n) + 1 of each. The order puts shingles that are frequent in
a bounded sample last; any order gives the same links, this one keeps common passages out of the prefixes.

Only prefixes are stored and shuffled, a fifth of the shingles, and after one aggregation only those of their
shingles that several texts have (a bitmap of a fixed size tells which; what it lets through besides finds no
partner). Texts of candidate pairs are read again, and their sets compared by 32 bits of each shingle's hash.

Texts of one set are one node. Only pairs that aren't yet connected are verified: a round against one pivot of
each group of texts that share a prefix shingle connects most of what is alike, at a cost in proportion to the
group; further ones follow where many pairs are left. What is left unconnected is then compared pair by pair. In
large groups the join itself drops pairs that differ in more than a threshold allows: of each set the parities of
its hashes in ``SKETCH`` classes are kept, and two sets differ in at least as many shingles as parities.

Words are split at ASCII white space, ASCII letters lower-cased, as in ``simhash``. A text of fewer words than a
shingle has is one shingle; null texts and texts without words are one empty set. Ids are integers (cast to long).
Null ids are kept as rows, link like any other and take no part in a component's smallest id; rows that repeat an
id are linked through it. Other columns are ignored, or passed through whole where one row of each group is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm import simhash
from pagewarden.llm.common import bitmap, bounded_batches, marked, passing, stored, tidied
from pagewarden.llm.decontaminate import Hasher
from pagewarden.llm.groups import components, connected, one_of_each
from pagewarden.llm.simhash import LOWER

SIZE = 5
THRESHOLD = 0.8
#: Documents of the sample that orders shingles, and the most frequent of its shingles that are told apart.
SAMPLE_ROWS = 10_000
FREQUENT = 500_000
#: After a round of pivots all open pairs are compared once there are under so many, or so many a row, or after so many rounds.
PAIRS = 2_000_000
PAIRS_PER_ROW = 200
ROUNDS = 4
#: Classes of hashes whose parities are kept of each set (a multiple of 64), and the size of groups from which their pairs are sifted by these.
SKETCH = 2048
LARGE = 16


def shingles(text: str | None, hasher: Hasher) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if 0 < len(words) < hasher.size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(hasher(words))


def prefix_length(n: int, threshold: float) -> int:
    """How many first shingles of n are enough to meet every similar set."""
    return n - math.ceil(threshold * n - 1e-9) + 1 if n else 0


def frequent_shingles(docs: DataFrame, text_col: str, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that several texts of a sample share."""
    bounded_batches(docs.sparkSession)

    def hashed(batches):
        hasher = Hasher(size)
        for batch in batches:
            sets = [shingles(t.as_py(), hasher).view(np.int64) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int64()))], ["hashes"])

    texts = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(max(1, rows // SAMPLE_ROWS))) == 0)
    counts = texts.distinct().mapInArrow(hashed, "hashes array<long>").select(F.explode("hashes").alias("h")).groupBy("h").count()
    top = counts.where("count > 1").orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas()
    keys = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["count"].to_numpy(np.int64)[order]


def set_of(found: np.ndarray) -> int:
    """The hash that stands for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64))


def parities(found: np.ndarray) -> np.ndarray:
    """Whether a set has an odd number of shingles, for each class of hashes, as bits."""
    odd = np.bincount((found % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, rows: int, size: int, threshold: float) -> DataFrame:
    """(id, twin, fp, sim, n, sketch, prefix), stored: hashes of each row's text and of its set, the text's fingerprint, the set's size, parities and first shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text_col, rows, size))
    longs = pa.list_(pa.int64())
    schema = pa.schema([("id", pa.int64()), ("twin", pa.int64()), ("fp", pa.int64()), ("sim", pa.int64()), ("n", pa.int32()), ("sketch", longs), ("prefix", longs)])

    def made(batches):
        hasher, (keys, counts) = Hasher(size), sent.value
        for batch in batches:
            fps, sims, sizes, sketches, prefixes = [], [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), hasher)
                known = np.zeros(len(found), np.int64)
                if len(keys) and len(found):
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    known = np.where(keys[at] == found, counts[at], 0)
                first = found[np.argsort(known, kind="stable")][: prefix_length(len(found), threshold)]
                fps.append(set_of(found))
                sims.append(simhash.signed(simhash.fingerprint(text.as_py())))
                sizes.append(len(found))
                sketches.append(parities(found))
                prefixes.append(first.view(np.int64))
            columns = [batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip((fps, sims, sizes, sketches, prefixes), list(schema)[2:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("twin"), F.col(text_col).alias("text"))
    out = stored(texts.mapInArrow(made, "id long, twin long, fp long, sim long, n int, sketch array<long>, prefix array<long>"), "sets")
    sent.destroy()
    return out


def fingerprint_pairs(sets: DataFrame, rows: int) -> DataFrame:
    """(a, b), a < b: sets whose fingerprints are equal or linked by multi-index hashing; one set stands for all of a fingerprint."""
    nodes = stored(sets.groupBy("sim").agg(F.min("fp").alias("rep")), "nodes", rows)
    left, right = (nodes.select(F.col("sim").alias(c), F.col("rep").alias(f"{c}_fp")) for c in "ab")
    near = simhash.links(nodes.select(F.col("sim").alias("fp"))).join(left, "a").join(right, "b")
    pairs = near.select("a_fp", "b_fp").union(sets.select("sim", "fp").join(nodes, "sim").select("fp", "rep")).where("a_fp <> b_fp")
    return pairs.select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b")).distinct()


def shared_prefixes(sets: DataFrame) -> DataFrame:
    """(fp, n, own, hs, places), stored: of each set the prefix shingles that other sets have in their prefixes, and a few more; ``own``: how many others there are."""
    several = sets.select(F.explode("prefix").alias("h")).groupBy("h").count().where("count > 1")  # copies of a text count too: they find no partner
    sent = sets.sparkSession.sparkContext.broadcast(bitmap(several.select("h")))
    kinds = [("fp", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("hs", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))]

    def kept(batches):
        for batch in batches:
            places, hs, own = [], [], []
            for prefix in batch.column(2):
                found = prefix.values.to_numpy()
                at = np.flatnonzero(marked(found, sent.value))
                places.append(at.astype(np.int32))
                hs.append(found[at])
                own.append(len(found) - len(at))
            columns = [batch.column(0), batch.column(1), *(pa.array(c, t) for c, (_, t) in zip((own, hs, places), kinds[2:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds))

    rows = sets.select("fp", "n", "prefix").mapInArrow(kept, "fp long, n int, own int, hs array<long>, places array<int>").where(F.size("hs") > 0)
    out = stored(rows.groupBy("fp").agg(F.first(F.struct("n", "own", "hs", "places")).alias("s")).select("fp", "s.*"), "members")
    sent.destroy()
    return out


def arrays_of(texts: DataFrame, twins: DataFrame, size: int) -> DataFrame:
    """(fp, hashes), stored: sets of the texts (text) whose hashes are in a table (twin), and of a few more."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap(twins))
    schema = pa.schema([("fp", pa.int64()), ("hashes", pa.list_(pa.int32()))])

    def made(batches):
        hasher = Hasher(size)
        for batch in batches:
            wanted = np.flatnonzero(marked(batch.column(0).to_numpy(), sent.value)).tolist()
            found = [shingles(batch.column(1)[k].as_py(), hasher) for k in wanted]
            hashes = [np.unique(x.astype(np.uint32)).view(np.int32) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_of, found), pa.int64()), pa.array(hashes, schema[1].type)], schema=schema)

    rows = texts.select(F.xxhash64("text").alias("twin"), "text").mapInArrow(made, "fp long, hashes array<int>")
    out = stored(rows.groupBy("fp").agg(F.first("hashes").alias("hashes")), "arrays")
    sent.destroy()
    return out


def side(members: DataFrame, name: str, *more: str) -> DataFrame:
    """One side of the pairs of a shingle's members."""
    return members.select("h", *[F.col(c).alias(f"{name}_{c}") for c in ("fp", "n", "pos", "comp", *more)])


def possible(threshold: float):
    """What the sizes of two sets and the places of their first common shingle allow."""
    least = F.lit(threshold / (1 + threshold)) * (F.col("a_n") + F.col("b_n")) - 1e-6
    return F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) >= least


def not_too_different(threshold: float):
    """What the parities of two sets allow: the sets differ in at least as many shingles."""
    apart = F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int"))
    most = F.lit((1 - threshold) / (1 + threshold)) * (F.col("a_n") + F.col("b_n")) + 1e-6
    return F.aggregate(apart, F.lit(0), lambda total, x: total + x) <= most


def open_pairs(labelled: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs of a shingle's members (h, m, major, fp, n, pos, comp) that aren't connected and may be similar; some repeatedly."""
    near = (F.col("a_comp") != F.col("b_comp")) & ((F.col("b_comp") == F.col("b_major")) | (F.col("a_fp") < F.col("b_fp"))) & possible(threshold)
    large = labelled.where(F.col("m") >= LARGE)
    sketches = sets.join(large.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.first("sketch").alias("sketch"))
    found = []
    for members, more, fits in ((labelled.where(F.col("m") < LARGE), [], near), (large.join(sketches, "fp"), ["sketch"], near & not_too_different(threshold))):
        a, b = side(members.where("comp <> major"), "a", *more), side(members, "b", "major", *more)
        found.append(a.join(b, "h").where(fits).select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b")))
    return found[0].union(found[1])


def similar(pairs: DataFrame, texts: DataFrame, twins: DataFrame, size: int, threshold: float) -> DataFrame:
    """(a, b): the stored pairs whose similarity reaches the threshold. Only sets of these pairs are shuffled."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    arrays = arrays_of(texts, twins.join(wanted, "fp", "left_semi").select("twin"), size)
    left, right = (arrays.select(F.col("fp").alias(c), F.col("hashes").alias(f"{c}_hashes")) for c in "ab")
    shared = F.size(F.array_intersect("a_hashes", "b_hashes"))
    total = F.size("a_hashes") + F.size("b_hashes")
    return pairs.join(left, "a").join(right, "b").where(shared * (1 + threshold) >= total * threshold - 1e-6).select("a", "b")


def links(sets: DataFrame, texts: DataFrame, rows: int, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame | None:
    """(a, b): pairs of similar sets; every two similar sets are connected by these. None if there are none."""
    spark = sets.sparkSession
    twins = stored(sets.groupBy("fp").agg(F.min("twin").alias("twin")), "twins", rows)
    members = shared_prefixes(sets)
    with passing(spark, "pairs", "similar"):
        tried = stored(fingerprint_pairs(sets, rows), "pairs", rows)
        found = None if tried.isEmpty() else stored(similar(tried, texts, twins, size, threshold), "similar", rows)
    for turn in range(ROUNDS + 1):
        with passing(spark, "pairs", "similar"):  # what a round has stored besides goes with it
            labelled = members.withColumn("comp", F.col("fp"))
            if found is not None:
                roots = components(found, rows).withColumnsRenamed({"node": "fp", "root": "_root"})
                labelled = members.join(roots, "fp", "left").withColumn("comp", F.coalesce("_root", "fp"))
            labelled = labelled.select("fp", "n", "own", "comp", F.inline(F.arrays_zip(F.col("hs").alias("h"), F.col("places").alias("pos"))))
            groups = labelled.groupBy("h", "comp").agg(F.count("*").alias("c"))
            groups = groups.groupBy("h").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"), F.max_by("comp", "c").alias("major"))
            # after a round of pivots both members of a pair have met
            open_ = stored(groups.where("m * m > q" if turn == 0 else "m * m > q and m > 2"), "open", rows)
            pairs = open_.agg(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2)).first()[0]
            if pairs is None:
                return found
            last = turn == ROUNDS or (turn > 0 and pairs <= max(PAIRS, PAIRS_PER_ROW * rows))
            labelled = stored(labelled.join(open_.select("h", "m", "major"), "h"), "labelled")
            if last:  # all pairs of different components
                new = open_pairs(labelled, sets, threshold).distinct()
            else:  # each against one of the group that has little of its own, as originals of copies do; later ones lie outside of its largest component
                order = F.struct((F.col("comp") == F.col("major")) if turn else F.lit(False), "own", F.xxhash64("fp", F.lit(turn)))
                pivots = labelled.groupBy("h").agg(F.min_by(F.struct("fp", "n", "pos", "comp"), order).alias("p")).select("h", "p.*")
                met = side(pivots, "a").join(side(labelled, "b"), "h").where((F.col("a_comp") != F.col("b_comp")) & possible(threshold))
                new = met.select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b")).distinct()
            new = stored(new.join(tried, ["a", "b"], "left_anti"), "pairs")
            edges = stored(similar(new, texts, twins, size, threshold), "similar", rows)
            found = edges if found is None else found.union(edges)
            tried = tried.union(new)
            if last:
                return found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD
) -> DataFrame:
    """(id, fp, component) per row: a hash of its set and the smallest id among all rows that links reach."""
    with tidied(docs.sparkSession):
        sets = shingle_sets(docs, id_col, text_col, docs.count(), size, threshold)
        rows = sets.count()
        edges = links(sets, docs.select(F.col(text_col).alias("text")), rows, size, threshold)
        return connected(sets.select("id", "fp"), edges, rows)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component, that of the smallest id, with all columns; see ``groups.one_of_each``."""
    with tidied(docs.sparkSession):
        return one_of_each(docs, near_duplicates(docs, id_col, text_col, **how), id_col)
