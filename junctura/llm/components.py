"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.shared import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours of each node at the smallest of them and the node itself.

    The large star does so for the neighbours above the node, the small star for those below it
    and the node. Both keep the components and shorten the paths.
    """
    if large:
        sided = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sided = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Written, so that both sides of the join are plain shuffles, of which Spark can split a hub.
    lows = sided.groupBy("a").agg(F.min("b").alias("low"))
    lows = stage(lows.select("a", F.least("a", "low").alias("low")), "lows")
    moved = sided.filter("b > a") if large else sided
    moved = moved.join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        moved = moved.unionByName(lows.select("a", F.col("low").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """One row (node, root) per node of ``edges`` (a, b) that isn't the smallest of its component.

    Alternates large and small stars until nothing changes, which takes a number of rounds that
    grows with the logarithm of the nodes. Every round is written to the shared folder; the driver
    sees a count and a checksum only. Loops are ignored; an empty table gives an empty one.
    """
    now = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        now = stage(_star(_star(now, large=True), large=False), "edges")
        check = now.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))
        ).first()
        if check == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = check
