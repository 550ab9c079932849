"""Connected components by minimum labels, over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.store import materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, label): the smallest node that each can reach.

    Each round replaces the edges by their endpoints' smallest neighbours: a node's
    neighbours link to the smallest of its neighbourhood instead of to it (large and
    small stars in turn), which keeps the components and halves the distances. Every
    round is a written table, and the driver sees one row of sums a round.
    """
    rows = edges.count()  # no round has more
    current = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    state = _state(current)
    while True:
        large = _star(current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        current, before = materialise(_star(large, larger=False), "edges", 2 * rows), state
        state = _state(current)
        if state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _state(edges: DataFrame) -> tuple:
    """How many edges there are, and sums over 96 bits of hashes that tell one set of edges from another; the edges are distinct."""
    parts = [F.sum(x) for h in (F.xxhash64("a", "b"), F.xxhash64("b", "a", F.lit(7))) for x in (F.shiftrightunsigned(h, 40), h.bitwiseAND(F.lit(0xFFFFFF)))]
    return tuple(edges.agg(F.count("*"), *parts).first())


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """links (a, b): each a's smallest neighbour or itself m; the larger (or all) neighbours of a link to m, and a too where all do."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    near = links.join(least, "a")
    if larger:
        return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()
