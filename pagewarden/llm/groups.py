"""Groups of rows that links connect: components of a graph of fingerprints, and one row of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import stored, without


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root): for each node of the edges (a, b) the smallest node that it reaches. ``rows``: about how many there are.

    Large-star and small-star rounds in turn, each stored in the shared folder, until nothing changes. No
    group of neighbours is ever gathered: a round takes minima and joins.
    """

    def state(e):
        return e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first()

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    seen = state(now)
    first = seen[0]  # a round never has more edges than twice as many
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = stored(small.where("a <> b").distinct(), "edges", 2 * first)
        if (then := state(now)) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = then


def same_ids(fps: DataFrame, rows: int) -> DataFrame | None:
    """(a, b): edges between the fingerprints of rows (id, fp) that share an id; None if no id has several."""
    pairs = fps.where("id is not null").groupBy("id").agg(F.min("fp").alias("b"), F.max("fp").alias("y"))
    shared = stored(pairs.where("b <> y").select("id", "b"), "shared", rows)
    if shared.isEmpty():
        return None
    return fps.join(shared, "id").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()


def connected(fps: DataFrame, edges: DataFrame | None, rows: int) -> DataFrame:
    """(id, fp, component): rows (id, fp), stored, with the smallest id among all rows that edges and equal ids reach.

    Null ids are reached through like any other; a component of nothing else has none.
    """
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes", rows)
    found = [e for e in (edges, same_ids(fps, rows)) if e is not None]
    if not found:
        return fps.join(nodes, "fp").select("id", "fp", F.col("least").alias("component"))
    roots = components(found[0] if len(found) == 1 else found[0].union(found[1]), rows).withColumnRenamed("node", "fp")
    labelled = stored(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots", rows)
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component"))
    return fps.join(labelled.join(smallest, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """One row of each component of (id, component), that of the smallest id, with all columns.

    Of rows that repeat an id one stays. Rows with a null id are never dropped.
    """
    found = stored(found.where("id is not null"), "components", rows := docs.count())
    left = without(docs, id_col, stored(found.where("id <> component").select("id").distinct(), "gone", rows))
    repeated = stored(found.groupBy("id").count().where("count > 1").select("id"), "repeated", rows)
    if repeated.isEmpty():
        return left
    again = repeated.toDF("_again")
    return without(left, id_col, repeated).unionByName(left.join(again, left[id_col] == again["_again"], "left_semi").dropDuplicates([id_col]))
