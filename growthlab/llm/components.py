"""Connected components of a link table, as joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlab.functions.ordered import materialize


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node below which something hangs hangs below nothing itself, and no
    node hangs below two: then each edge leads to its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    open_nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return open_nodes.where((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("least") == 0))).isEmpty()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge, the component being its least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until only stars
    are left: a logarithmic number of rounds, each writing at most one row per edge.
    Groups are reduced with a map-side minimum; no component is ever gathered in a task."""
    now = materialize(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
                      .where(F.col("u") != F.col("v")).distinct())
    while True:
        now = materialize(_small(_large(now)))
        if _stars(now):
            break
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
