"""Connected components of an undirected graph that may have very large stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.llm.common import lookup, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for each node of ``edges`` (columns a, b; longs).

    Each round points every node at its smallest neighbour, follows the pointers to their ends, and
    contracts the edges to those ends. The number of nodes that are left at least halves in a round.
    """
    left = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    root = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = _followed(stored(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("root"))))
        if root is None:
            root = pointer
        else:
            root = stored(_moved(root, pointer, "root"))
        ends = _moved(_moved(left, pointer, "a"), pointer, "b")
        left = stored(ends.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if root is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return root


def _moved(rows: DataFrame, pointer: DataFrame, column: str) -> DataFrame:
    """``rows`` with the values of a column replaced by where they point; others stay."""
    rows = stored(rows)
    aims = pointer.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    uses = rows.groupBy(column).agg(F.count("*").alias("__uses"))
    targets = stored(uses.join(aims, F.col(column) == F.col("__node"), "left").select(column, "__uses", F.coalesce("__root", column).alias("__to")))
    out = lookup(rows, targets, [column], "__uses", max(1, rows.count()))
    return out.withColumn(column, F.col("__to")).select(*rows.columns)


def _followed(pointer: DataFrame) -> DataFrame:
    """Pointer doubling: pointers lead to smaller nodes, so they end; each pass halves the way."""
    while True:
        was = pointer.select("node", F.col("root").alias("__was"))
        pointer = stored(_moved(pointer, pointer, "root"))
        if pointer.join(was, "node").filter("root != __was").isEmpty():
            return pointer
