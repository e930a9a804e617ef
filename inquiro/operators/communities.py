"""Communities by modularity on graphs of any size: colours, moves, contraction.

A level starts with each node alone. Nodes are coloured so that neighbours
differ (Jones and Plassmann: in each round the nodes whose hash is largest among
their uncoloured neighbours take the round's colour); the nodes of one colour
then move at once, each to the neighbouring community of the largest gain in
modularity, which its neighbours, standing still, cannot spoil. Passes over the
colours go on while the modularity of the whole graph rises; a pass that lowers
it is undone. Then each community becomes one node, with the summed weights of
its links, for the next level, until a level gains nothing.

Every step is joins and sums over the edge table: no component, community or
neighbourhood meets in one task, and nothing depends on the graph's size. A node
that is dense in links would need as many colours as it has neighbours; after
`colours` rounds the nodes left over are dealt to these colours by hash. They may
meet a moving neighbour; a move between two single nodes then goes to the lower
number alone, so no pair swaps, and the pass as a whole is still held to the gain.

The result is a Louvain partition, but not that of visiting nodes one after the
other in order of id (graph.swept_communities), which is sequential by its rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquiro.operators.numbering import numbered
from inquiro.storage import materialize

COLOURS, PASSES, LEVELS = 4, 10, 12
EPSILON = 1e-4  # a pass or level must raise the modularity by more


def coloured(nodes: DataFrame, near: DataFrame, colours: int = COLOURS) -> DataFrame:
    """(id, colour) of nodes(id) over near(a, b), both ways and without loops;
    colours from 0 on, neighbours' differ but for those dealt by hash at the end."""
    left = nodes.select("id", F.xxhash64("id").alias("h"))
    done = None
    for colour in range(colours):
        most = near.join(left.select(F.col("id").alias("b"), F.col("h").alias("bh")), "b").groupBy(F.col("a").alias("id")).agg(F.max(F.struct("bh", "b")).alias("most"))
        judged = materialize(left.join(most, "id", "left").withColumn("wins", F.col("most").isNull() | (F.struct(F.col("h").alias("bh"), F.col("id").alias("b")) > F.col("most"))))
        taken = judged.filter("wins").select("id", F.lit(colour).alias("colour"))
        done = taken if done is None else done.unionByName(taken)
        left = judged.filter("not wins").select("id", "h")
        if not left.take(1):
            return done
    return done.unionByName(left.select("id", F.pmod(F.xxhash64("h"), F.lit(colours)).cast("int").alias("colour")))


def modularity(state: DataFrame, near: DataFrame, inside: float, total: float) -> float:
    """Of state(id, k, own) over near(a, b, w); inside: weights of loops."""
    ends = near.join(state.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(state.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    kept = ends.filter("x = y").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("kept"))
    spread = state.groupBy("own").agg(F.sum("k").alias("all")).agg(F.coalesce(F.sum(F.col("all") * F.col("all")), F.lit(0.0)).alias("spread"))
    found = kept.crossJoin(spread).first()  # a row each
    return (found.kept + inside) / total - found.spread / total**2


def _moved(state: DataFrame, near: DataFrame, colour: int, total: float) -> DataFrame:
    """state after the nodes of one colour have moved."""
    groups = state.groupBy(F.col("own").alias("c")).agg(F.sum("k").alias("all"), F.count("*").alias("members"))
    movers = state.filter(F.col("colour") == colour)
    links = near.join(movers.select(F.col("id").alias("a")), "a").join(state.select(F.col("id").alias("b"), F.col("own").alias("c")), "b").select(F.col("a").alias("id"), "c", "w")
    links = links.unionByName(movers.select("id", F.col("own").alias("c"), F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"))
    both = links.join(movers.select("id", "k", "own"), "id").join(groups, "c").join(groups.select(F.col("c").alias("own"), F.col("members").alias("own_members")), "own")
    others = F.col("all") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("w") - others * F.col("k") / total, 9)
    swaps = (F.col("members") == 1) & (F.col("own_members") == 1) & (F.col("c") > F.col("own"))
    fit = both.withColumn("gain", gain).filter(~swaps)
    # of equal gains the present community, then the lower number
    best = fit.groupBy("id").agg(F.min_by("c", F.struct(-F.col("gain"), (F.col("c") != F.col("own")).alias("other"), "c")).alias("to"))
    return state.join(best, "id", "left").select("id", "k", "colour", F.coalesce("to", "own").alias("own"))


def _level(nodes: DataFrame, near: DataFrame, inside: float, total: float, colours: int, passes: int) -> tuple[DataFrame, float, float]:
    """(state, modularity at the start, at the end) of local moves over
    nodes(id, k) and near(a, b, w)."""
    tinted = coloured(nodes, near, colours)
    state = materialize(nodes.join(tinted, "id").select("id", "k", "colour", F.col("id").alias("own")))
    used = [r[0] for r in state.select("colour").distinct().orderBy("colour").collect()]  # at most `colours` numbers
    began = now = modularity(state, near, inside, total)
    for _ in range(passes):
        after = state
        for colour in used:
            after = materialize(_moved(after, near, colour, total))
        found = modularity(after, near, inside, total)
        if found <= now + EPSILON:
            break
        state, now = after, found
    return state, began, now


def communities(nodes: DataFrame, adj: DataFrame, *, colours: int = COLOURS, passes: int = PASSES, levels: int = LEVELS) -> DataFrame:
    """(id, community) of nodes(id) over adj(a, b), both ways, without loops or
    repeats: communities numbered from 0 by their least member."""
    number = materialize(numbered(nodes.select("id").distinct(), "id", name="v"))
    ends = adj.join(number.select(F.col("id").alias("a"), F.col("v").alias("from")), "a").join(number.select(F.col("id").alias("b"), F.col("v").alias("to")), "b")
    near = materialize(ends.select(F.col("from").alias("a"), F.col("to").alias("b"), F.lit(1.0).alias("w")))
    total = float(near.count())
    placed = number.select("id", "v", F.col("v").alias("own"))
    inside = 0.0
    if total:
        strength = materialize(near.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
        for _ in range(levels):
            state, began, now = _level(strength, near, inside, total, colours, passes)
            if now <= began + EPSILON:
                break
            own = state.select(F.col("id").alias("own"), F.col("own").alias("next"))
            placed = materialize(placed.join(own, "own", "left").select("id", "v", F.coalesce("next", "own").alias("own")))
            # communities become nodes; what lies inside them counts as loops
            met = near.join(state.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(state.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
            summed = materialize(met.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")))
            inside += summed.filter("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
            near, strength = summed.filter("a <> b"), materialize(state.groupBy(F.col("own").alias("id")).agg(F.sum("k").alias("k")))
    first = placed.groupBy("own").agg(F.min("v").alias("first"))
    order = numbered(first, "first", name="community")
    return placed.join(order, "own").select("id", (F.col("community") - 1).alias("community"))
