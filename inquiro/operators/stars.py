"""Connected components of a link table by alternating stars.

Each round is two joins of a node with its least neighbour and a distinct; no
neighbourhood is gathered. A node's links meet one row of its own (its least
neighbour), so a hub is a skewed join side, which Spark splits, and never a
square of rows. The number of rounds grows with the logarithm of a
component's size; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquiro.storage import materialize


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """One star step over (u, v) with u > v: large links every neighbour
    above u to u's least neighbour, small every neighbour below."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        links = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        links = edges.join(least, F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v")
    return links.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the least node
    reachable."""
    state = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    seen = None
    while True:
        state = materialize(_star(_star(state, large=True), large=False))
        sign = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen:
            break
        seen = sign
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
