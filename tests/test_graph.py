import random

import pytest
from pyspark.sql import functions as F

from inquiro.operators import communities, graph, sampled


def build(spark, pairs, ids):
    edges = spark.createDataFrame([(a, b, "CALLED") for a, b in pairs], "src string, dst string, type string")
    return spark.createDataFrame([(x,) for x in ids], "id string"), edges, graph.adjacency(edges)


def test_star(spark):
    nodes, edges, adj = build(spark, [("a", "b"), ("a", "c"), ("a", "d"), ("a", "b"), ("a", "a")], "abcde")
    assert dict(graph.degrees(nodes, adj).collect()) == {"a": 3, "b": 1, "c": 1, "d": 1, "e": 0}
    assert sum(r.pagerank for r in graph.pagerank(nodes, adj).collect()) == pytest.approx(1)
    got = dict(graph.betweenness(nodes, adj).collect())
    assert got["a"] == pytest.approx(3 / 6) and got["b"] == 0
    assert {r.id: r.dist for r in graph.neighborhood(edges, "b", 2).collect()} == {"b": 0, "a": 1, "c": 2, "d": 2}


def test_two_cliques(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    nodes, _, adj = build(spark, pairs, "abcdefg")
    got = dict(graph.communities(nodes, adj).collect())
    assert got["a"] == got["b"] == got["c"] == 0 and got["d"] == got["e"] == got["f"] == 1 and got["g"] == 2
    assert dict(graph.components(adj, nodes).collect()) == {**{x: "a" for x in "abcdef"}, "g": "g"}




def shortest_paths(adj, nodes):
    """Betweenness by counting every pair's shortest paths."""
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for u in sorted(adj[v]):
                if u not in dist:
                    dist[u], paths[u] = dist[v] + 1, 0.0
                    order.append(u)
                if dist[u] == dist[v] + 1:
                    paths[u] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in adj[v]:
                if dist[u] == dist[v] - 1:
                    share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                score[v] += share[v]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_betweenness_in_blocks(spark):
    rnd = random.Random(3)
    ids = [f"n{i:02d}" for i in range(30)]
    pairs = [(rnd.choice(ids[:25]), rnd.choice(ids[:25])) for _ in range(40)]
    nodes, _, adj = build(spark, pairs, ids)
    near = {v: set() for v in ids}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = shortest_paths(near, ids)
    for rows, sources in ((100, 11), (10_000_000, 32)):  # three rounds of a lane each; one lane
        assert dict(graph.betweenness(nodes, adj, rows=rows, sources=sources).collect()) == pytest.approx(want)


def quality(pairs, placed):
    """Modularity by its definition."""
    m, degree = len(pairs), {}
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    inside = sum(placed[a] == placed[b] for a, b in pairs)
    weight = {}
    for v, k in degree.items():
        weight[placed[v]] = weight.get(placed[v], 0) + k
    return inside / m - sum((w / (2 * m)) ** 2 for w in weight.values())


def test_communities_of_a_large_component(spark):
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "abc" for i in range(6) for j in range(i)] + [("a0", "b0"), ("b1", "c1")]
    nodes, _, adj = build(spark, pairs, sorted({x for p in pairs for x in p} | {"z"}))
    swept = graph.swept_communities(nodes, adj)
    for placed in (graph.communities(nodes, adj), swept):
        got = dict(placed.collect())
        assert {c: {got[f"{c}{i}"] for i in range(6)} for c in "abc"} == {"a": {0}, "b": {1}, "c": {2}} and got["z"] == 3
    assert {r.community: r["size"] for r in graph.community_sizes(swept).collect()} == {0: 6, 1: 6, 2: 6, 3: 1}


def test_communities_of_planted_graphs(spark):
    """Not below the sequential sweep, and groups that are plain are found."""
    rng = random.Random(12)
    for inside, across in ((0.55, 0.04),):
        names = [f"n{k:03d}" for k in range(90)]
        pairs = [(a, b) for i, a in enumerate(names) for j, b in enumerate(names[:i]) if rng.random() < (inside if i // 15 == j // 15 else across)]
        nodes, _, adj = build(spark, pairs, names)
        got, swept = dict(graph.communities(nodes, adj).collect()), dict(graph.swept_communities(nodes, adj).collect())
        assert quality(pairs, got) >= quality(pairs, swept) - 1e-9
        assert len({(got[x], k // 15) for k, x in enumerate(names)}) == 6


def test_colours_of_neighbours_differ(spark):
    rng = random.Random(13)
    pairs = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(140)) if a != b}
    rows = sorted(pairs | {(b, a) for a, b in pairs})
    near = spark.createDataFrame(rows, "a long, b long")
    colour = {r.id: r.colour for r in communities.coloured(spark.range(70), near, colours=25).collect()}
    assert len(colour) == 70 and all(colour[a] != colour[b] for a, b in rows)
    few = {r.id: r.colour for r in communities.coloured(spark.range(70), near, colours=2).collect()}
    assert len(few) == 70 and set(few.values()) <= {0, 1}


def test_sampled_betweenness(spark):
    """All errors within the bound, the leaders found, reruns equal; nodes in
    other components and without edges too."""
    rng = random.Random(15)
    names = [f"n{k:02d}" for k in range(40)]
    pairs = [(names[k], names[rng.randrange(k)]) for k in range(1, 30)] + [(rng.choice(names[:30]), rng.choice(names[:30])) for _ in range(12)] + [(names[k], names[k + 1]) for k in range(30, 37)]
    nodes, _, adj = build(spark, [p for p in pairs if p[0] != p[1]], names)
    exact, got = dict(graph.betweenness(nodes, adj).collect()), dict(graph.sampled_betweenness(nodes, adj, error=0.03).collect())
    assert set(got) == set(names) and max(abs(got[x] - exact[x]) for x in names) <= 0.03 * 40 / 38
    top = sorted(names, key=lambda x: -exact[x])
    assert len(set(top[:5]) & set(sorted(names, key=lambda x: -got[x])[:7])) == 5 and got["n38"] == got["n39"] == 0


def test_paths_that_are_drawn(spark):
    """A line has one path a pair; a square's two are drawn evenly."""
    nodes, _, adj = build(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "abcde")
    exact, got = dict(graph.betweenness(nodes, adj).collect()), dict(graph.sampled_betweenness(nodes, adj, error=0.05).collect())
    assert got["a"] == got["e"] == 0 and all(abs(got[x] - exact[x]) < 0.08 for x in "bcd")
    assert sampled.samples_for(0.1, 0.1, 5) == 216 and sampled.samples_for(0.01, 0.1, 5) == 21513
    assert dict(graph.sampled_betweenness(nodes, adj.limit(0)).collect()) == dict.fromkeys("abcde", 0.0)


def test_communities_without_edges(spark):
    nodes, _, adj = build(spark, [], ["b", "a"])
    assert dict(graph.communities(nodes, adj).collect()) == {"a": 0, "b": 1}
    assert graph.communities(nodes.limit(0), adj).count() == 0


def test_many_starts_equal_single_ones(spark):
    rng = random.Random(21)
    rows = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice(["CALLED", "OWNS"])) for _ in range(70)] + [("n1", "n1", "OWNS")]
    edges = spark.createDataFrame(rows, "src string, dst string, type string")
    starts = [f"n{k}" for k in range(0, 60, 7)] + ["nobody"]
    got = {}
    for r in graph.neighborhoods(edges, spark.createDataFrame([(x,) for x in starts + ["n0"]], "start string"), 3, ["CALLED"]).collect():
        assert r.id not in got.setdefault(r.start, {})
        got[r.start][r.id] = r.dist
    near = {}
    for a, b, t in rows:
        if t == "CALLED":
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for x in starts:
        dist = {x: 0}
        for hop in range(1, 4):
            for v in [v for v, k in dist.items() if k == hop - 1]:
                for u in near.get(v, ()):
                    dist.setdefault(u, hop)
        assert got[x] == dist, x
    assert got["n7"] == {r.id: r.dist for r in graph.neighborhood(edges, "n7", 3, ["CALLED"]).collect()}
    few = graph.neighborhoods(edges, spark.createDataFrame([(x,) for x in starts], "start string"), 2, None, 3)
    assert all(r["count"] <= 3 for r in few.groupBy("start").count().collect()) and few.filter("dist = 0").count() == len(starts)


def test_subgraph(spark):
    rows = [("e1", "a", "b", "CALLED"), ("e2", "b", "c", "OWNS"), ("e3", "c", "d", "CALLED"), ("e4", "b", "d", "CALLED"), ("e5", "c", "c", "CALLED")]
    edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, type string")
    nodes = spark.createDataFrame([("a", "Person"), ("b", "Phone"), ("c", "Vehicle"), ("d", "Phone")], "id string, label string")

    def ids(*args, **kw):
        n, e, cut = graph.subgraph(nodes, edges, *args, **kw)
        return [r.id for r in n.collect()], [r.edge_id for r in e.collect()], cut

    assert ids("a") == (["a", "b"], ["e1"], False) and ids("a", 2) == (["a", "b", "c", "d"], ["e1", "e2", "e4"], False)
    assert ids("a", 3)[1] == ["e1", "e2", "e3", "e4", "e5"] and ids("a", 2, ["CALLED"]) == (["a", "b", "d"], ["e1", "e4"], False)
    assert ids("a", 2, None, ["Phone"]) == (["a", "b", "d"], ["e1", "e4"], False) and ids("a", 3, limit_nodes=2, limit_edges=1) == (["a", "b"], ["e1"], True)
    for bad in (lambda: ids("a", 4), lambda: ids("a", 1, ["KNOWS"])):
        with pytest.raises(ValueError):
            bad()
    assert (graph.clamp(0, 100, 500), graph.clamp(900, 100, 500), graph.clamp(-3, 100, 500)) == (100, 500, 1)
    types = spark.createDataFrame([("USES",), ("OWNS",), ("KNOWS",)], "t string")
    assert [r.x for r in types.select(graph.relation(F.col("t")).alias("x")).collect()] == ["USED", "OWNS", None]
    assert [r.edge_id for r in graph.skipped_edges(nodes.filter("id <> 'd'"), edges).orderBy("edge_id").collect()] == ["e3", "e4"]
    assert graph.repeated_ids(nodes.union(nodes.limit(1))).count() == 1 and graph.missing(nodes, nodes.limit(3), "id").count() == 1
    assert {r.person: r.reach for r in graph.shared_contact_reach(spark.createDataFrame([("p", "x"), ("q", "x"), ("q", "y"), ("r", "y"), ("s", "z")], "person string, contact string")).collect()} == {"p": 1, "q": 2, "r": 1}
