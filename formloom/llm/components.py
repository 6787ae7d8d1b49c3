"""Connected components of a graph too large for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a, b: of any type with an order) reaches.

    Alternating large-star and small-star rounds: every round is two shuffles of the edges that are
    left, and their number of rounds is logarithmic in the longest path. Each round's table is written
    to the shared folder, so lineage stays short and no executor's loss undoes it. Edges from a node to
    itself and repeated edges add nothing; an empty table has no components.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        old = edges
        # Large star: every larger neighbour of a node moves to the node's least neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        edges = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every smaller neighbour, and the node, move to the least of them.
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = written(edges)
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select("b", "b").distinct().toDF("id", "component"))
        before = now
