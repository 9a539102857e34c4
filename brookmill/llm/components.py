"""Connected components of a table of links, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.llm.store import discard, written


def _state(edges: DataFrame) -> tuple:
    """A number of rows and a sum of hashes, equal for equal tables."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _lowest(edges: DataFrame) -> DataFrame:
    """For each u the least of its neighbours; written, so that a hub's edges can be split in the join with it."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "stars")


def connected(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b): root is the component's least node.

    Each round ties every node's larger neighbours, then its smaller ones, to
    the least node in reach, until nothing changes: a logarithmic number of
    rounds in practice. Minima are combined within tasks before they shuffle,
    and nothing but two numbers a round comes to the driver. Links from a node
    to itself, nulls and repeated links do not matter.
    """
    tidy = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(tidy, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both)
        large = written(both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        least = _lowest(large)
        tied = large.join(least, "u")
        small = tied.select("u", F.col("m").alias("v")).unionByName(tied.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        following = written(small.distinct(), "edges")
        new = _state(following)
        for done in (edges, low, large, least):
            discard(done)  # at once: rounds may be many
        edges, same, state = following, new == state, new
        if same:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
