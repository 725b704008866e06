"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Each node's neighbours (large star: those above it; small star: those below it) go to its least one."""
    around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = around.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge table (u, v); root is the component's least node.

    Nodes may be of any type that Spark can order. Each round is two aggregations with map-side combining and two joins,
    whose hot keys adaptive execution splits; the edge table is written to the shared folder between rounds, the one before is deleted, and
    nothing but whether a node is in the wrong place comes to the driver.
    """
    e = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = shared.table(e, "edges")
    for _ in range(most_rounds):
        new = shared.table(_star(_star(e, True), False), "edges")
        shared.forget(e)
        e = new
        if settled(e):
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: every u has one edge, and no v is anyone's u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or (up > 0 and root > 0)")
    return not odd.limit(1).count()
