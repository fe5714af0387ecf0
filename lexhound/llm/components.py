"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_table, materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) to (node, component): the smallest node that can be reached, of every node with an edge to another.

    Each round hangs every node's larger neighbours on its smallest neighbour, then its smaller neighbours and itself on
    the smallest; edges only move towards the smallest node, so a star remains of each component after about log n
    rounds. Each round is written to the shared folder: lineage stays short and a lost executor costs a round at most.
    The neighbours of one node are never gathered: the minimum comes by aggregation, and a join by node is split by
    Spark's adaptive skew handling where a node has very many.
    """
    def tidy(e: DataFrame) -> DataFrame:
        pairs = e.where(F.col("a") != F.col("b"))
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    current = materialise(tidy(edges.select("a", "b")), "edges")
    signature = _signature(current)
    for _ in range(max_rounds):
        # large star: u's larger neighbours take the minimum of u and its neighbours
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: edges point from larger to smaller here; u's smaller neighbours and u take the minimum
        small_in = tidy(large)
        low = small_in.groupBy("a").agg(F.min("b").alias("m"))
        small = small_in.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        nxt = materialise(tidy(small), "edges")
        now = _signature(nxt)
        delete_table(current)
        current = nxt
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(r)
