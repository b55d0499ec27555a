"""Connected components of a distributed edge table by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffsieve.llm._common import forgotten, written

#: More passes than any graph of 2**60 vertices takes.
MAX_PASSES = 64


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, n): the smallest of every vertex and its neighbours on either side of (u, v), and their number. Spark
    combines before the shuffle, so a vertex with very many edges is never gathered."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every vertex hands its larger neighbours to the smallest of all. `least` has been written, so that both sides of
    the join are plain shuffles, of which adaptive execution splits the one of a vertex with very many edges."""
    moved = edges.join(least.select(F.col("u").alias("v"), "m"), "v")
    return moved.select("u", F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands itself and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of the edges (a, b): the smallest vertex reachable. Loops and repeated edges
    are allowed; vertices without an edge have no row."""
    given = written(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    # A vertex with many smaller neighbours keeps one: most of what was given says the same again.
    state = written(_small_star(given), "edges")
    forgotten(given)
    for _ in range(MAX_PASSES):
        least = written(_least(state), "least")
        # Stars: every vertex that is not the smallest of its neighbourhood has one neighbour, the centre.
        if least.filter("m < u and n > 1").isEmpty():
            forgotten(least)
            break
        after = written(_small_star(_large_star(state, least)), "edges")
        forgotten(state)
        forgotten(least)
        state = after
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("id"), F.col("v").alias("component"))
    ).distinct()
