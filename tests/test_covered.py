"""Betweenness over a cover against the search from all nodes."""

import random

import pytest

from inquiro.operators import covered, graph


@pytest.mark.parametrize("hubs, others, share, within", [(3, 40, 0.5, 0.0), (8, 60, 0.15, 0.0), (8, 50, 0.12, 0.2), (12, 30, 0.08, 0.1)])
def test_equals_the_search(spark, monkeypatch, hubs, others, share, within):
    rnd = random.Random(hubs * others)
    edges = [(f"u{i}", f"k{j}", "CALLED") for i in range(others) for j in range(hubs) if rnd.random() < share]
    edges += [(f"k{i}", f"k{j}", "CALLED") for i in range(hubs) for j in range(i) if rnd.random() < within]
    edges += [("a", "b", "CALLED"), ("b", "c", "CALLED"), ("c", "d", "CALLED")]
    df = spark.createDataFrame(edges, "src string, dst string, type string")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for e in edges for x in e[:2]} | {"alone"})], "id string")
    adj = graph.adjacency(df)
    want = {r.id: r.betweenness for r in graph.betweenness(nodes, adj, cover=0).collect()}
    plain = covered.covered_betweenness
    used = []
    monkeypatch.setattr(graph, "covered_betweenness", lambda *a: used.append(1) or plain(*a, block=16))
    got = {r.id: r.betweenness for r in graph.betweenness(nodes, adj).collect()}
    assert used and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want), {k: (got[k], want[k]) for k in want if abs(got[k] - want[k]) >= 1e-9}
    assert covered.cover_of(spark.createDataFrame([(i, i + 1) for i in range(30)] + [(i + 1, i) for i in range(30)], "from long, to long"), 5) is None
