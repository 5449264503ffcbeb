"""Connected components of an edge table, by alternating star steps over Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.llm.work import attach, stored

MOST_ROUNDS = 60


def _down(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller node."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour.

    All links lead down, so that is the least node that the lower end leads to, or the lower end
    itself. A root has as many links as its component has nodes; they are dealt by salt.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    met = attach(edges, ["b"], least.withColumnRenamed("a", "b"), by=["a"])
    return met.select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    several = least.where("n > 1").select("a", "m")
    tied = attach(edges, ["a"], several, by=["b"]).where("m is not null").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (id, component), the least id that each linked id can reach.

    Each round is written to the shared folder, so lineage stays short; the rounds grow with the
    logarithm of the longest path. The end is found by comparing counts and an order-free hash.
    """
    now, before = _down(edges), None
    for _ in range(MOST_ROUNDS):
        now = stored(_small_star(_large_star(now)), "stars")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = mark
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
