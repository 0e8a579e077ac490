"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinweave.session import durable


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Tie neighbours of each node to the least of them.

    The least neighbour is a partial aggregate, so a node with very many neighbours costs one row per task; the join
    has one row per node on its right side, and adaptive execution divides the rows of such a node on its left.
    """
    if larger_only:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("node", "m").alias("m"))
    joined = both.join(least, both.a == least.node)
    if larger_only:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two columns ``a, b`` of long): root is the least node reachable.

    Each round writes its edges to the shared folder, so lineage stays short and a lost executor costs one round. The
    number of rounds grows with the logarithm of a component's size. An edge from a node to itself or a null end is
    no edge.
    """
    now = durable(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct())
    mark = _mark(now)
    while mark[0]:
        now = durable(_star(_star(now, larger_only=True), larger_only=False))
        then, mark = mark, _mark(now)
        if then == mark:
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Stars repeat themselves once every edge leads to a root: then the set of edges is what it was."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0
