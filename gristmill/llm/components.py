"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import stored


def _facts(edges: DataFrame) -> tuple:
    """Tells two edge lists apart: their number and an order-free sum of hashes."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is tied to the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of each node of edges (u, v) other than the smallest of its component; component is that smallest.

    Edges of a node with itself and repeated edges do no harm. No step makes more rows than twice the edges; a node with
    many neighbours is only ever aggregated and joined, never gathered in one place. Ends after O(log^2) rounds.
    """
    now = stored(_small(edges.where("u <> v")), "edges")
    facts = _facts(now)
    while facts[0]:
        now = stored(_small(_large(now)), "edges")
        new = _facts(now)
        if new == facts:
            break
        facts = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
