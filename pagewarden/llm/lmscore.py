"""Language-model scoring by cross-entropy difference.

Two n-gram models of the same order, smoothing and vocabulary are counted: one on the target documents, one
on the whole corpus as the background. Tokens are UTF-16 code units: the shared vocabulary is every unit of
the corpus, so no word list has to be cut and every character counts. N-grams of ``ORDER`` units are counted per
task, summed over the corpus, and blended with all lower orders by Witten-Bell smoothing. A document's score is
its mean loss per token under the target model less that under the background model: the lower, the more it is
like the target.

No document is scored by a model that has counted it: documents are dealt to ``FOLDS`` folds by a hash of their
id, and each is scored by both models as counted on the other folds.

Every n-gram of the corpus is in the tables, so scoring looks each one up in a table of the losses for every
fold. The table is sent in blocks of at most ``BLOCK_BYTES``, each a pass over the documents; partial sums add up.

Ids are integers (cast to long). Defined results: null is scored like the empty text, which has one token, its
end; null ids are a fold's. Rows with equal id and text get equal scores, one row each. Without target documents in
the other folds both models back off to the same uniform start, and the target's loss is that. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import bounded_batches, fits, stored

ORDER, FOLDS = 4, 2
BITS = 16
#: Markers, which are no characters.
START, END = 0xFFFE, 0xFFFF
#: N-grams that a task gathers before it sorts them, and counts that it holds before it hands them on.
GATHERED, HELD = 1 << 20, 1 << 21
BLOCK_BYTES, ENTRY_BYTES = 48 << 20, 8 + 8 * FOLDS
#: Columns of counts and of losses: of the background (n) and the target (m) outside of each fold.
MODELS = [f"{kind}_{fold}" for fold in range(FOLDS) for kind in "nm"]


def fold_of(id_col: Column) -> Column:
    """The fold of a row."""
    return F.pmod(F.xxhash64(id_col.cast("string")), F.lit(FOLDS)).cast("int")


def grams(text: str | None) -> np.ndarray:
    """The n-gram that ends at each token, as packed code units."""
    units = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    padded = np.concatenate((np.full(ORDER - 1, START, np.uint64), units, np.array([END], np.uint64)))
    n = len(units) + 1
    packed = np.zeros(n, np.uint64)
    for k in range(ORDER):
        packed = (packed << np.uint64(BITS)) | padded[k : k + n]
    return packed


class Counts:
    """Counts of n-grams in bounded memory."""

    def __init__(self):
        self.raw, self.n_raw = [], 0
        self.codes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, codes: np.ndarray) -> None:
        self.raw.append(codes)
        self.n_raw += len(codes)
        if self.n_raw >= GATHERED:
            self.settle()

    def settle(self) -> None:
        if self.raw:
            codes, counts = np.unique(np.concatenate(self.raw), return_counts=True)
            self.raw, self.n_raw = [], 0
            codes, counts = np.concatenate((self.codes, codes)), np.concatenate((self.counts, counts))
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            self.codes, self.counts = codes[first], np.add.reduceat(counts, first)

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        out = self.codes, self.counts
        self.codes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        return out


def count_grams(docs: DataFrame, text_col: str, target: Column, fold: Column) -> DataFrame:
    """(gram, n_0, m_0, ...): occurrences in the corpus and in the target documents, outside of each fold."""
    bounded_batches(docs.sparkSession)

    def counted(batches):
        kinds = {(f, inside): Counts() for f in range(FOLDS) for inside in (False, True)}

        def drained(kind: tuple[int, bool]):
            codes, counts = kinds[kind].drain()
            for k in range(0, len(codes), 1 << 16):
                n = counts[k : k + (1 << 16)]
                made = codes[k : k + (1 << 16)].view(np.int64), np.full(len(n), kind[0], np.int32), n, n if kind[1] else np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["gram", "fold", "n", "m"])

        for batch in batches:
            for text, *kind in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:])):
                counts = kinds[tuple(kind)]
                counts.add(grams(text.as_py()))
                if len(counts.codes) > HELD:
                    yield from drained(tuple(kind))
        for kind in kinds:
            yield from drained(kind)

    rows = docs.select(F.col(text_col).alias("text"), fold.alias("fold"), F.coalesce(target, F.lit(False)).alias("inside"))
    found = rows.mapInArrow(counted, "gram long, fold int, n long, m long")
    outside = lambda kind, f: F.sum(F.when(F.col("fold") == f, 0).otherwise(F.col(kind)))
    return found.groupBy("gram").agg(*[outside(x[0], int(x[2:])).alias(x) for x in MODELS])


def losses(counts: DataFrame) -> DataFrame:
    """(gram, n_0, m_0, ...): bits of each n-gram's last token after its others, under each model."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        key = F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
        levels[k] = levels[k + 1].groupBy(key.alias("gram")).agg(*[F.sum(x).alias(x) for x in MODELS])
    whole = levels[1].agg(F.count("*").alias("v"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in MODELS]).first()
    found = levels[1].select("gram", *[((F.col(x) + 1) / F.lit(float(whole[x] + whole.v))).alias(f"p_{x}") for x in MODELS])
    for k in range(2, ORDER + 1):
        context = F.shiftrightunsigned("gram", BITS).alias("context")
        rows = levels[k].select("*", context, F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1)).alias("lower"))
        after = rows.groupBy("context").agg(*[c for x in MODELS for c in (F.sum(x).alias(f"all_{x}"), F.count_if(F.col(x) > 0).alias(f"kinds_{x}"))])
        joined = rows.join(after, "context").join(found.withColumnRenamed("gram", "lower"), "lower")

        def blend(x: str) -> Column:
            n, total, kinds, low = (F.col(f"{c}{x}") for c in ("", "all_", "kinds_", "p_"))
            return F.when(total > 0, (n + kinds * low) / (total + kinds)).otherwise(low)

        found = joined.select("gram", *[blend(x).alias(f"p_{x}") for x in MODELS])
    return found.select("gram", *[(-F.log2(f"p_{x}")).cast("float").alias(x) for x in MODELS])


def blocks(table: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The table of losses in sorted blocks of a bounded size: n-grams, and the losses."""
    n = max(1, -(-table.count() * ENTRY_BYTES // BLOCK_BYTES))
    for k in range(n):
        part = table if n == 1 else table.where(F.pmod(F.xxhash64("gram"), F.lit(n)) == k)
        found = part.toArrow()
        codes = found["gram"].to_numpy().view(np.uint64)
        order = np.argsort(codes)
        yield codes[order], np.stack([found[x].to_numpy()[order] for x in MODELS], axis=1)


def add_losses(docs: DataFrame, table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, target_bits, background_bits) per row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("id"), F.xxhash64(text_col).alias("twin"), fold_of(key).alias("fold"), F.col(text_col).alias("text"))
    found, passes = None, 0
    for block in blocks(table):
        sent = spark.sparkContext.broadcast(block)

        def scored(batches, sent=sent):
            codes, lost = sent.value
            for batch in batches:
                n, sums = [], []
                for fold, text in zip(batch.column(2).to_pylist(), batch.column(3)):
                    own, times = np.unique(grams(text.as_py()), return_counts=True)
                    at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
                    known = codes[at] == own if len(codes) else np.zeros(len(own), bool)
                    n.append(int(times.sum()))
                    sums.append(times[known] @ lost[at[known], 2 * fold : 2 * fold + 2].astype(np.float64))
                sums = np.array(sums).reshape(-1, 2)
                columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sums[:, 1]), pa.array(sums[:, 0])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "twin", "n_tokens", "t", "b"])

        part = rows.mapInArrow(scored, "id long, twin long, n_tokens long, t double, b double")
        found, passes = part if found is None else found.unionAll(part), passes + 1
    if passes > 1:  # rows with equal id and text meet; each has had every pass
        copies = (F.count("*") / passes).cast("long")
        found = found.groupBy("id", "twin").agg(F.max("n_tokens").alias("n_tokens"), (F.sum("t") / copies).alias("t"), (F.sum("b") / copies).alias("b"), copies.alias("k"))
        found = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    return found.select("id", "n_tokens", F.col("t").alias("target_bits"), F.col("b").alias("background_bits"))


def score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) per row; ``target_ids`` has one column."""
    ids = target_ids.toDF("_target").where("_target is not null").distinct()
    if fits(ids.count()):
        ids = F.broadcast(ids)
    joined = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id") == F.col("_target"), "left")
    table = stored(losses(stored(count_grams(joined, "text", F.col("_target").isNotNull(), fold_of(F.col("id"))), "grams")), "losses")
    found = add_losses(docs, table, id_col, text_col)
    per = lambda c: F.col(c) / F.col("n_tokens")
    return found.select(
        "id", "n_tokens", per("target_bits").alias("target_loss"), per("background_bits").alias("background_loss"),
        ((F.col("target_bits") - F.col("background_bits")) / F.col("n_tokens")).alias("score"),
    )
