"""PageRank over a cover against round by round, and scans of the views."""

import random

import pytest
from pyspark.sql import functions as F

from inquiro.operators import features, graph
from inquiro.plans import views as V


@pytest.mark.parametrize("rounds, tolerance", [(0, 0.0), (1, 0.0), (10, 0.0), (100, 1e-3)])
def test_equals_the_rounds(spark, monkeypatch, rounds, tolerance):
    rnd = random.Random(rounds)
    edges = [(f"u{i}", f"k{j}") for i in range(50) for j in range(7) if rnd.random() < 0.2] + [("k0", "k1"), ("k2", "k5"), ("a", "b"), ("b", "c")]
    nodes = spark.createDataFrame([(x,) for x in sorted({x for e in edges for x in e} | {"alone", "other"})], "id string")
    adj = graph.adjacency(spark.createDataFrame(edges, "src string, dst string"))
    want = {r.id: r.pagerank for r in graph.pagerank(nodes, adj, rounds=rounds, tolerance=tolerance, cover=0).collect()}
    plain, written = graph.materialize, []
    monkeypatch.setattr(graph, "materialize", lambda df: written.append(1) or plain(df))
    got = {r.id: r.pagerank for r in graph.pagerank(nodes, adj, rounds=rounds, tolerance=tolerance).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert len(written) <= 3  # not a table a round


def _events(spark, tmp_path):
    rows = [(i, i % 4, ["purchase", "click", None][i % 3], i / 3, '{"k": %d}' % (i % 13)) for i in range(40)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    e.withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("event_id") * 7000)).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_edges_scan_events_once(spark, tmp_path):
    d = _events(spark, tmp_path)
    e = V.edges(spark, d)
    assert e._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    c = V.calls(spark, d).select("caller", "receiver", F.lit("CALLED"), "ts", "call_id")
    t = V.transfers(spark, d).select("sender", "receiver", F.lit("TRANSFERRED_TO"), "ts", "source_id")
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, c.union(t).collect()))


def test_legs_are_made_after_their_sides_part(spark, tmp_path):
    d = _events(spark, tmp_path)
    me, other, paid = F.col("person"), F.concat(F.lit("K"), F.col("k").cast("string")), F.col("event_type") == "purchase"
    e = V._events(spark, d)
    sides = [F.when(paid, features.leg(x, "transfer", F.col("ts"), amount=F.col("value"))).otherwise(features.leg(x, "call", F.col("ts"), contact=y, duration=F.col("value"))) for x, y in ((me, other), (other, me))]
    place = features.leg(me, "place", F.to_date("ts"), location=F.concat(F.lit("L"), (F.col("k") % 10).cast("string")))
    want = e.select(F.explode(F.array(*sides, place)).alias("l")).select("l.*")
    got = V.legs(spark, d)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1
