"""Connected components of a graph given as links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideledger.llm.cluster import settled


def _pointed(edges: DataFrame, everything: bool) -> DataFrame:
    """Replace links by links to the least neighbour.

    ``edges`` hold (a, b) with a > b. Large star: larger neighbours of a node point to the
    least of all its neighbours; small star: the node and its smaller neighbours do.
    """
    if everything:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a").toDF("u", "v"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = around.join(least, "u")
    if everything:
        pointed = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        pointed = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return pointed.where("a > b").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every linked node; the root is the least node of its component.

    Runs until nothing changes, whatever number of rounds that takes (it grows with the
    logarithm of the longest chain). Every round is settled in the shared folder.
    """
    edges = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a > b").distinct()
    edges, before = settled(edges), None
    while True:
        edges = settled(_pointed(_pointed(edges, everything=True), everything=False))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
