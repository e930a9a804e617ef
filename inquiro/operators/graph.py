"""The typed property graph as node and edge tables, and its measures."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inquiro.operators import stars
from inquiro.operators.communities import communities
from inquiro.operators.covered import COVER, Covered, cover_of, covered, covered_betweenness, covered_pagerank
from inquiro.operators.numbering import numbered
from inquiro.operators.sampled import sampled_betweenness
from inquiro.operators.unions import union_sizes
from inquiro.storage import materialize

NEAR = 4096  # neighbours of a list in PageRank's moves, about
ROWS, SOURCES = 4_000_000, 32  # (lane, edge) pairs that a round of betweenness walks at once; sources of a lane


def adjacency(edges: DataFrame) -> DataFrame:
    """(a, b) both ways, without loops or parallels."""
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    return nodes.join(adj.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


@dataclass
class Prepared:
    """Numbers of a graph's nodes from 0, its links by them, and the graph by
    its cover, where few nodes touch all edges."""

    number: DataFrame  # (id, v)
    ends: DataFrame  # (from, to), both ways
    over: Covered | None


def prepared(nodes: DataFrame, adj: DataFrame, cover: int = COVER) -> Prepared:
    """What several measures of one graph share."""
    number = materialize(numbered(nodes.select("id").distinct(), "id").select("id", (F.col("n") - 1).alias("v")))
    ends = adj.join(number.select(F.col("id").alias("a"), F.col("v").alias("from")), "a").join(number.select(F.col("id").alias("b"), F.col("v").alias("to")), "b")
    ends = materialize(ends.select("from", "to"))
    hubs = cover_of(ends, cover) if cover else None
    return Prepared(number, ends, covered(ends, hubs) if hubs else None)


def pagerank(nodes: DataFrame, adj: DataFrame, *, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, cover: int = COVER, ready: Prepared | None = None) -> DataFrame:
    """(id, pagerank): stops when the ranks move by less than the tolerance
    in all; nodes without edges spread their rank evenly. Where at most `cover`
    nodes touch all edges, all rounds are walked on these (covered_pagerank)."""
    n = max(1, nodes.count())
    ready = ready or prepared(nodes, adj, cover)
    if ready.over:
        found, rest = covered_pagerank(ready.over, n, damping=damping, rounds=rounds, tolerance=tolerance)
        ranks = materialize(nodes.select("id").join(ready.number.join(found, "v").select("id", "r"), "id", "left").select("id", F.coalesce("r", F.lit(rest)).alias("r")))
        total = ranks.agg(F.sum("r")).first()[0] or 1.0
        return ranks.select("id", (F.col("r") / F.lit(total)).alias("pagerank"))
    deg = degrees(nodes, adj)
    # neighbours in lists of some thousands: a round moves a row a list, not a row an edge
    lists = F.pmod(F.xxhash64("b"), F.floor(F.col("degree") / NEAR) + 1)
    moves = materialize(adj.join(deg.select(F.col("id").alias("a"), "degree"), "a").groupBy("a", lists.alias("_list")).agg(F.collect_list("b").alias("bs")).select("a", "bs"))
    ranks = materialize(deg.select("id", "degree", F.lit(1.0 / n).alias("r")))
    idle = F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("r"))), F.lit(0.0))
    dangling = ranks.agg(idle).first()[0]
    for _ in range(rounds):
        sent = moves.join(ranks.filter("degree > 0").select(F.col("id").alias("a"), (F.col("r") / F.col("degree")).alias("r")), "a").select(F.explode("bs").alias("id"), "r")
        given = sent.groupBy("id").agg(F.sum("r").alias("got"))
        new = ranks.select("id", "degree", F.col("r").alias("old")).join(given, "id", "left").select("id", "degree", "old", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(dangling / n))).alias("r"))
        new = materialize(new)
        shift, dangling = new.agg(F.coalesce(F.sum(F.abs(F.col("r") - F.col("old"))), F.lit(0.0)), idle).first()
        ranks = new.select("id", "degree", "r")
        if shift < tolerance:
            break
    total = ranks.agg(F.sum("r")).first()[0] or 1.0
    return ranks.select("id", (F.col("r") / F.lit(total)).alias("pagerank"))


def minmax(scores: DataFrame, column: str) -> DataFrame:
    b = scores.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    spread = (b.hi - b.lo) if b.hi is not None else 0.0
    return scores.withColumn(column, (F.col(column) - F.lit(b.lo or 0.0)) / F.lit(spread) if spread else F.lit(0.0))


# Relationship types, their alias, how deep and how much.
REL_TYPES = ("CALLED", "MET", "LOCATED_AT", "OWNS", "USED", "TRANSFERRED_TO", "ASSOCIATED_WITH", "MENTIONED_IN", "WORKS_FOR", "TRAVELLED_TO")
REL_ALIASES = {"USES": "USED"}
MAX_DEPTH, NODE_LIMITS, EDGE_LIMITS = 3, (100, 500), (300, 1500)


def relation(c: Column) -> Column:
    """The relationship type, aliases resolved; null if it is none of ours."""
    known = c
    for alias, name in REL_ALIASES.items():
        known = F.when(known == alias, name).otherwise(known)
    return F.when(known.isin(*REL_TYPES), known)


def clamp(limit: int, default: int, most: int) -> int:
    """0 means the default; else between 1 and the most."""
    return max(1, min(int(limit), most)) if int(limit) else default


def check_depth(depth: int) -> int:
    if not 1 <= int(depth) <= MAX_DEPTH:
        raise ValueError("INVALID_DEPTH")
    return int(depth)


def check_types(values: list[str] | None, allowed: tuple[str, ...]) -> list[str] | None:
    if unknown := sorted(set(values or ()) - set(allowed)):
        raise ValueError(f"INVALID_FILTER: {unknown}")
    return list(values) if values else None


def neighborhood(edges: DataFrame, start: str, depth: int, types: list[str] | None = None, nodes: DataFrame | None = None, labels: list[str] | None = None) -> DataFrame:
    """(id, dist) within `depth` undirected hops of start over edges of the
    given types and, if labels are given, nodes(id, label) of those labels:
    one frontier join a hop, the visited nodes anti-joined."""
    e = edges.filter(F.col("type").isin(types)) if types else edges
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    if labels:
        both = both.join(nodes.filter(F.col("label").isin(labels)).select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, dist int")
    front = seen
    for hop in range(1, depth + 1):
        front = both.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("dist", F.lit(hop))
        front = materialize(front)
        seen = seen.unionByName(front)
    return seen


def neighborhoods(edges: DataFrame, starts: DataFrame, depth: int, types: list[str] | None = None, limit_nodes: int | None = None) -> DataFrame:
    """(start, id, dist) within `depth` undirected hops of every start of
    starts(start), all in one search: a hop is one join for all starts. In an
    undirected graph a hop's neighbours lie on it, before or behind it, so only
    the last two levels are taken off. With limit_nodes, the nearest nodes of
    each start, then first by id (the feature's cap)."""
    e = edges.filter(F.col("type").isin(types)) if types else edges
    both = materialize(e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct())
    front = materialize(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("dist")).distinct())
    levels = [front]
    for hop in range(1, depth + 1):
        new = both.join(front.select("start", F.col("id").alias("a")), "a").select("start", F.col("b").alias("id")).distinct()
        for before in levels[-2:]:
            new = new.join(before.select("start", "id"), ["start", "id"], "left_anti")
        front = materialize(new.withColumn("dist", F.lit(hop)))
        levels.append(front)
    out = reduce(DataFrame.unionByName, levels)
    if limit_nodes is None:
        return out
    nearest = Window.partitionBy("start").orderBy("dist", "id")
    return out.withColumn("_k", F.row_number().over(nearest)).filter(F.col("_k") <= limit_nodes).drop("_k")


def neighborhood_sizes(edges: DataFrame, starts: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """(start, dist, n): how many nodes neighborhoods() finds at each distance.
    Up to two hops they are counted in unions of neighbour sets, so the pairs
    of starts and nodes are not made; farther ones are counted from the search."""
    if depth > 2:
        return neighborhoods(edges, starts, depth, types).groupBy("start", "dist").agg(F.count("*").alias("n"))
    e = edges.filter(F.col("type").isin(types)) if types else edges
    adj = materialize(adjacency(e))
    starts = materialize(starts.select("start").distinct())
    near = materialize(adj.join(starts.select(F.col("start").alias("a")), "a", "left_semi").select(F.col("a").alias("start"), F.col("b").alias("member")))
    sizes = [starts.select("start", F.lit(0).alias("dist"), F.lit(1).cast("long").alias("n"))]
    if depth > 0:
        sizes.append(near.groupBy("start").agg(F.count("*").alias("n")).select("start", F.lit(1).alias("dist"), "n"))
    if depth > 1:
        seen = near.unionByName(starts.select("start", F.col("start").alias("member")))
        far = union_sizes(near.select("start", F.col("member").alias("key")), adj.select(F.col("a").alias("key"), F.col("b").alias("member")), seen)
        sizes.append(far.filter("n > 0").select("start", F.lit(2).alias("dist"), "n"))
    return reduce(DataFrame.unionByName, sizes)


def subgraph(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 1, types: list[str] | None = None, labels: list[str] | None = None, limit_nodes: int = 0, limit_edges: int = 0) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes with dist, edges, truncated): what lies within `depth` hops.

    An edge belongs to it if one end is nearer than depth and the other
    passes the label filter, that is, if a walk of that length uses it. Limits
    are the feature's; the nearest nodes and first edges by id are kept.
    """
    check_depth(depth)
    types = check_types(types, REL_TYPES)
    most_nodes, most_edges = clamp(limit_nodes, *NODE_LIMITS), clamp(limit_edges, *EDGE_LIMITS)
    near = materialize(neighborhood(edges, start, depth, types, nodes, labels))
    inner = near.filter(F.col("dist") < depth).select("id")
    e = edges.filter(F.col("type").isin(types)) if types else edges
    out = e.join(inner.select(F.col("id").alias("src"), F.lit(1).alias("s")), "src", "left").join(inner.select(F.col("id").alias("dst"), F.lit(1).alias("d")), "dst", "left").filter("s is not null or d is not null").drop("s", "d")
    ends = near.select("id")
    out = out.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
    if labels:  # a walk enters each node but the first through the filter; a loop at the start does not pass
        fit = nodes.filter(F.col("label").isin(labels)).select("id")
        bad = (F.col("src") == start) & (F.col("dst") == start)
        out = out.filter(~bad) if not fit.filter(F.col("id") == start).take(1) else out
    found = near.join(nodes, "id").orderBy("dist", "id").limit(most_nodes + 1)
    kept_edges = out.orderBy("edge_id").limit(most_edges + 1)
    found, kept_edges = materialize(found), materialize(kept_edges)
    truncated = found.count() > most_nodes or kept_edges.count() > most_edges
    return found.orderBy("dist", "id").limit(most_nodes), kept_edges.orderBy("edge_id").limit(most_edges), truncated


def components(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the least id reachable; isolates are their own."""
    roots = stars.components(adj).withColumnRenamed("node", "id")
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def betweenness(nodes: DataFrame, adj: DataFrame, *, rows: int = ROWS, sources: int = SOURCES, cover: int = COVER, ready: Prepared | None = None) -> DataFrame:
    """(id, betweenness): exact, over all shortest paths.

    Where at most `cover` nodes touch all edges, by tiles of pairs over that
    cover (covered_betweenness). On other graphs `sources` sources share a row: (node, lane, x0, x1, ..), one number for each
    of them, zero where the node is not on the level. A level is one join with
    the edges and one sum by node and lane; nodes of the two levels before
    count as NaN in that sum, so they drop out without a join (an undirected
    edge reaches no earlier one). Dependencies are summed level by level on
    the way back. Lanes go in rounds of about `rows` (lane, edge) pairs, which
    bounds the space; the time is nodes x edges steps, as exact betweenness
    takes. Nothing but counts reaches the driver.
    """
    n, m = nodes.count(), adj.count()
    if n < 3 or not m:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    ready = ready or prepared(nodes, adj, cover)
    number, ends = ready.number, ready.ends
    if ready.over:
        shares = number.join(covered_betweenness(ready.over), "v").select("id", "all")
        return nodes.select("id").join(shares, "id", "left").select("id", (F.coalesce("all", F.lit(0.0)) / float((n - 1) * (n - 2))).alias("betweenness"))
    xs = [f"x{i}" for i in range(sources)]
    lanes = max(1, rows // m)
    total = None

    def sent(level: DataFrame) -> DataFrame:
        """What each node's neighbours get of it."""
        return level.join(ends, F.col("v") == F.col("from")).select(F.col("to").alias("v"), "lane", *xs)

    def summed(messages: DataFrame) -> DataFrame:
        return messages.groupBy("v", "lane").agg(*[F.sum(x).alias(x) for x in xs])

    for first in range(0, -(-n // sources), lanes):
        own = number.withColumn("lane", F.floor(F.col("v") / sources)).filter(F.col("lane").between(first, first + lanes - 1))
        levels = [materialize(own.select("v", "lane", *[F.when(F.col("v") % sources == i, 1.0).otherwise(0.0).alias(x) for i, x in enumerate(xs)]))]
        while True:
            met = sent(levels[-1])
            for before in levels[-2:]:
                met = met.unionByName(before.select("v", "lane", *[F.when(F.col(x) > 0, F.lit(float("nan"))).otherwise(0.0).alias(x) for x in xs]))
            new = summed(met).select("v", "lane", *[F.nanvl(x, F.lit(0.0)).alias(x) for x in xs])
            new = materialize(new.filter(F.greatest(*xs) > 0))
            if not new.take(1):
                break
            levels.append(new)
        back = None  # of the level behind: (1 + dependency) / paths, zero where it has no paths
        for level in reversed(levels[1:]):
            here = level.select("v", "lane", *xs, *[F.lit(0.0).alias(f"d{x}") for x in xs])
            if back is not None:
                got = summed(sent(back)).select("v", "lane", *[F.col(x).alias(f"g{x}") for x in xs])
                here = level.join(got, ["v", "lane"], "left").select("v", "lane", *xs, *[(F.col(x) * F.coalesce(f"g{x}", F.lit(0.0))).alias(f"d{x}") for x in xs])
            all_of = sum((F.col(f"d{x}") for x in xs[1:]), F.col(f"d{xs[0]}"))
            back = materialize(here.select("v", "lane", *[F.when(F.col(x) > 0, (1 + F.col(f"d{x}")) / F.col(x)).otherwise(0.0).alias(x) for x in xs], all_of.alias("all")))
            part = back.groupBy("v").agg(F.sum("all").alias("all"))
            total = part if total is None else total.unionByName(part)
    if total is None:  # no edge has both ends among the nodes
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    shares = number.join(total.groupBy("v").agg(F.sum("all").alias("all")), "v").select("id", "all")
    return nodes.select("id").join(shares, "id", "left").select("id", (F.coalesce("all", F.lit(0.0)) / float((n - 1) * (n - 2))).alias("betweenness"))


def swept_communities(nodes: DataFrame, adj: DataFrame, *, passes: int = 10) -> DataFrame:
    """(id, community): local moves of modularity, node after node in order of
    id, numbered by least member. That rule is sequential within a component,
    so each component is swept in one task and must fit it; communities() has
    no such bound."""
    comp = materialize(components(adj, nodes))
    m2 = adj.count()

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.a) | set(pdf.b.dropna()))
        at = {x: i for i, x in enumerate(names)}
        near: list[list[int]] = [[] for _ in names]
        for a, b in zip(pdf.a, pdf.b):
            if isinstance(b, str):
                near[at[a]].append(at[b])
        own, strength = list(range(len(names))), [float(len(x)) for x in near]
        for _ in range(passes if m2 else 0):
            moved = False
            for v in range(len(names)):
                k, here = len(near[v]), own[v]
                strength[here] -= k
                links: dict[int, int] = {here: 0}
                for u in near[v]:
                    links[own[u]] = links.get(own[u], 0) + 1
                best, to = 0.0, here
                for c in sorted(links):
                    gain = (links[c] - strength[c] * k / m2) / m2
                    if gain > best + 1e-12:
                        best, to = gain, c
                strength[to] += k
                own[v], moved = to, moved or to != here
            if not moved:
                break
        first: dict[int, str] = {}
        for v, c in enumerate(own):
            first.setdefault(c, names[v])
        return pd.DataFrame({"id": names, "first": [first[c] for c in own]})

    rows = comp.select(F.col("id").alias("a"), "component").join(adj, "a", "left")
    placed = materialize(rows.groupBy("component").applyInPandas(sweep, "id string, first string"))
    number = numbered(placed.select("first").distinct(), "first", name="community")
    return placed.join(number, "first").select("id", (F.col("community") - 1).alias("community"))


def community_sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("community").agg(F.count("*").alias("size"))


def analyze(nodes: DataFrame, adj: DataFrame, betweenness_error: float | None = None) -> DataFrame:
    """(id, degree, pagerank, betweenness): PageRank from 0 to 1 over all
    nodes, betweenness as it is; exact, or within an error if one is given."""
    ready = prepared(nodes, adj)
    rank = minmax(pagerank(nodes, adj, ready=ready), "pagerank")
    between = betweenness(nodes, adj, ready=ready) if betweenness_error is None else sampled_betweenness(nodes, adj, error=betweenness_error)
    return degrees(nodes, adj).join(rank, "id").join(between, "id")


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of `new` that `old` lacks, the first of each id."""
    once = new.groupBy("edge_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "edge_id"]), "source").alias("e")).select("edge_id", "e.*")
    return once.join(old.select("edge_id"), "edge_id", "left_anti")


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, the first of each id, with `created`: whether old lacks it."""
    once = new.dropDuplicates(["id"])
    return once.join(old.select("id", F.lit(True).alias("_had")), "id", "left").withColumn("created", F.col("_had").isNull()).drop("_had")


def write_counts(old_nodes: DataFrame, old_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes and relationships created and existing, and edges
    skipped because an end was not built."""
    n = merge_nodes(old_nodes, nodes).agg(F.count_if("created").alias("nodes_created"), F.count_if(~F.col("created")).alias("nodes_existing"))
    built = edges.join(nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    once = built.dropDuplicates(["edge_id"]).join(old_edges.select("edge_id", F.lit(True).alias("_had")), "edge_id", "left")
    e = once.agg(F.count_if(F.col("_had").isNull()).alias("relationships_created"), F.count_if(F.col("_had").isNotNull()).alias("relationships_existing"))
    skipped = edges.agg(F.count("*").alias("_all")).crossJoin(built.agg(F.count("*").alias("_built"))).select((F.col("_all") - F.col("_built")).alias("skipped"))
    return n.crossJoin(e).crossJoin(skipped)  # one row each


def skipped_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, reason) of edges whose ends were not both built."""
    ids = nodes.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("edge_id").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("edge_id"))
    return out.distinct().withColumn("reason", F.lit("endpoint node not built"))


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """The wanted ids that are not there (empty: verified)."""
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """(label, id, n): ids that a label has more than once; none if unique."""
    return nodes.groupBy("label", "id").agg(F.count("*").alias("n")).filter("n > 1")


def get_entity(nodes: DataFrame, entity_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == entity_id)


def shared_contact_reach(pairs: DataFrame) -> DataFrame:
    """(person, reach): how many others share a contact with each person of
    pairs(person, contact): the size of the union of their contacts' persons.
    A popular contact is one bit set for all its persons (union_sizes), so
    neither its pairs nor a copy of its set for each person are made."""
    pairs = materialize(pairs.distinct())
    sets = pairs.select(F.col("contact").alias("key"), F.col("person").alias("member"))
    own = pairs.select(F.col("person").alias("start"), F.col("person").alias("member"))
    reach = union_sizes(pairs.select(F.col("person").alias("start"), F.col("contact").alias("key")), sets, own.distinct())
    return reach.filter("n > 0").select(F.col("start").alias("person"), F.col("n").alias("reach"))


def snapshot(nodes: DataFrame, edges: DataFrame, most_nodes: int = 2000, most_edges: int = 5000) -> tuple[DataFrame, DataFrame, tuple[bool, bool]]:
    """(first nodes by id, first edges by id, whether there are more of each):
    one row over a cap shows that it cuts."""
    n = materialize(nodes.orderBy("id").limit(most_nodes + 1))
    e = materialize(edges.orderBy("edge_id").limit(most_edges + 1))
    return n.orderBy("id").limit(most_nodes), e.orderBy("edge_id").limit(most_edges), (n.count() > most_nodes, e.count() > most_edges)
