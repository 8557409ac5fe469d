"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import dropped, staged

#: Far more rounds than any graph takes: the number grows with the logarithm of a path's length.
ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _linked(pairs: DataFrame, smaller: DataFrame) -> DataFrame:
    return pairs.join(smaller, "u").where("v <> m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a and b, longs): root is the
    smallest node reachable.

    Every round works on pairs only: a node's smallest neighbour is a sum of its
    partitions' smallest ones, and no neighbourhood is gathered into one row. Each
    round's edges are written to the shared folder. Nulls and loops are left out; an
    empty table has no nodes.
    """
    edges = staged(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _signature(edges)
    for _ in range(ROUNDS):
        if not before[0]:
            break
        # large star: hang each larger neighbour of a node on the smallest of its neighbourhood
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _linked(both.where("v > u"), least).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "large-star")
        # small star: hang a node and its smaller neighbours on the smallest of them
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _linked(down, least).select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        older, edges = edges, staged(small, "small-star")
        dropped(older, large)
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
