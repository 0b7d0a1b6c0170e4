"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b); ``root`` is the smallest node reachable.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until nothing
    changes, O(log^2 n) rounds.  Every step is a grouped minimum, aggregated
    before the shuffle, and an equi-join that can be split where a node has many
    links; each round is written to the shared folder.  Loops and repeated links
    do no harm; no links give no rows.
    """
    edges = stored(_directed(links.select("a", "b")), "links")
    state = _state(edges)
    while state[0]:
        before, edges = edges, stored(_small_star(_large_star(edges)), "links")
        now = _state(edges)
        discard(before)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()


def _directed(links: DataFrame) -> DataFrame:
    """Each link once, from its larger node to its smaller."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
    return _directed(larger.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _directed(moved.union(least.select("a", F.col("m").alias("b"))))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
