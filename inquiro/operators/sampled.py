"""Betweenness within a stated error, from sampled shortest paths.

After Riondato and Kornaropoulos: pairs of nodes are drawn, one shortest path of
each is drawn evenly from all of its shortest paths, and a node's betweenness is
the share of paths that pass through it. With

    r = 0.5 / error^2 * (floor(log2(D - 2)) + 1 + ln(1 / doubt))

paths, D at least the number of nodes on any shortest path, all nodes' errors
are at most `error` with probability 1 - doubt. r does not depend on the number
of nodes or edges, so the work is r searches, not nodes x edges steps.

All searches run together, from both ends of their pairs in turn: a level is one
join of the frontiers with the edges and one sum of path counts. In an undirected
graph a level's neighbours lie on it, before or behind it, so two levels are
taken off and no visited set is kept. Where the frontiers of a pair meet, one
meeting node is drawn by its path counts, and from there one step of a path a
join is drawn back to both ends. Draws are hashes of the sample's number, so a
rerun gives the same.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquiro.operators import stars
from inquiro.operators.numbering import numbered
from inquiro.storage import materialize

ERROR, DOUBT = 0.02, 0.1


def samples_for(error: float, doubt: float, diameter: int) -> int:
    """How many paths keep all errors within `error` with probability 1 - doubt."""
    inner = max(1, diameter - 2)
    return math.ceil(0.5 / error**2 * (math.floor(math.log2(inner)) + 1 + math.log(1 / doubt)))


def _draw(*of: Column) -> Column:
    """An even number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def _race(weight: Column, seed: int, use: int) -> Column:
    """The least of these belongs to a row with probability by its weight."""
    return -F.log(_draw(F.col("i"), F.col("v"), F.lit(seed), F.lit(use))) / weight


def path_nodes(edges: DataFrame, n: int) -> int:
    """An upper bound of the number of nodes on a shortest path: twice the
    depth of a search from the first node of every component, plus one."""
    roots = stars.components(edges.select(F.col("from").alias("a"), F.col("to").alias("b"))).select("root").distinct()
    front, before, depth = materialize(roots.select(F.col("root").alias("v"))), None, 0
    while depth < n:
        seen = front if before is None else front.unionByName(before)
        new = materialize(front.join(edges, F.col("v") == F.col("from")).select(F.col("to").alias("v")).distinct().join(seen, "v", "left_anti"))
        if not new.take(1):
            break
        front, before, depth = new, front, depth + 1
    return 2 * depth + 1


def sampled_betweenness(nodes: DataFrame, adj: DataFrame, *, error: float = ERROR, doubt: float = DOUBT, seed: int = 0) -> DataFrame:
    """(id, betweenness): as graph.betweenness(), each within `error` (times
    n / (n - 2)) with probability 1 - doubt for all nodes together."""
    n = nodes.select("id").distinct().count()
    if n < 3 or not adj.take(1):
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    number = materialize(numbered(nodes.select("id").distinct(), "id").select("id", (F.col("n") - 1).alias("v")))
    ends = adj.join(number.select(F.col("id").alias("a"), F.col("v").alias("from")), "a").join(number.select(F.col("id").alias("b"), F.col("v").alias("to")), "b")
    edges = materialize(ends.select("from", "to"))
    r = samples_for(error, doubt, path_nodes(edges, n))
    i = F.col("i")
    first = F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(n))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(i, F.lit(seed), F.lit(1)), F.lit(n - 1)), F.lit(n))
    pairs = materialize(nodes.sparkSession.range(r).select(F.col("id").alias("i"), F.lit(1.0).alias("paths"), first.alias("v0"), second.alias("v1")))
    levels = [[pairs.select("i", F.col(f"v{side}").alias("v"), "paths")] for side in (0, 1)]
    live, met, side = pairs.select("i"), [], 0
    while True:
        mine, other = levels[side], levels[1 - side]
        reached = mine[-1].join(live, "i").join(edges, F.col("v") == F.col("from")).groupBy("i", F.col("to").alias("v")).agg(F.sum("paths").alias("paths"))
        for old in mine[-2:]:
            reached = reached.join(old.select("i", "v"), ["i", "v"], "left_anti")
        front = materialize(reached)
        mine.append(front)
        both = front.join(other[-1].select("i", "v", F.col("paths").alias("far")), ["i", "v"])
        # one meeting node of each pair, drawn by the number of paths through it
        chosen = both.groupBy("i").agg(F.min_by("v", F.struct(_race(F.col("paths") * F.col("far"), seed, 2), "v")).alias("v"))
        found = materialize(chosen.select("i", "v", F.lit(len(levels[0]) - 1).alias("d0"), F.lit(len(levels[1]) - 1).alias("d1")))
        met.append(found)
        live = materialize(front.select("i").distinct().join(found, "i", "left_anti"))
        if not live.take(1):
            break
        side = 1 - side
    meetings = materialize(reduce(DataFrame.unionByName, met))
    passed = [meetings.filter("d0 > 0 and d1 > 0").select("v")]
    for side in (0, 1):
        walk = meetings.select("i", "v", F.col(f"d{side}").alias("d"))
        for level in range(len(levels[side]) - 2, 0, -1):
            at = walk.filter(F.col("d") == level + 1)
            back = at.join(edges, F.col("v") == F.col("to")).select("i", F.col("from").alias("v")).join(levels[side][level], ["i", "v"])
            taken = back.groupBy("i").agg(F.min_by("v", F.struct(_race(F.col("paths"), seed, 3 + side), "v")).alias("v")).select("i", "v", F.lit(level).alias("d"))
            walk = materialize(walk.filter(F.col("d") <= level).unionByName(taken))
            passed.append(walk.filter(F.col("d") == level).join(meetings.filter(F.col(f"d{side}") > level).select("i"), "i", "left_semi").select("v"))
    shares = reduce(DataFrame.unionByName, passed).groupBy("v").agg(F.count("*").alias("k"))
    return number.join(shares, "v", "left").select("id", (F.coalesce("k", F.lit(0)) * F.lit(n / (n - 2) / r)).alias("betweenness"))
