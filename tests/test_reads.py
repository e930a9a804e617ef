"""Activity, anomalies, the scoring run, and the reads over them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from inquiro.operators import analytics, anomaly, features, reads
from inquiro.streaming import calls as streaming


def test_both_sides_of_an_event_count(spark):
    people = spark.createDataFrame([("p1", "1", ["+1"], ["A1"]), ("p2", "2", ["+2", "+1"], ["A2"]), ("p3", "3", [], [])], "id string, created_at string, phones array<string>, accounts array<string>").select("id", "created_at", F.struct("phones", "accounts").alias("attributes"))
    calls = spark.createDataFrame([("+1", "+2", "2026-01-01T01:00:00Z", 10.0), ("+1", "+9", "2026-01-02T12:00:00Z", 20.0), ("+8", "+9", "2026-01-03T12:00:00Z", 1.0)], "caller string, receiver string, ts string, duration double")
    paid = spark.createDataFrame([("A1", "A1", "2026-01-01T00:00:00Z", 5.0), ("A2", "A9", "2026-01-05T00:00:00Z", 7.0)], "sender string, receiver string, ts string, amount double")
    seen = features.place_legs(spark.createDataFrame([("d1", "p1", "2026-01-01"), ("d1", "p1", "2026-01-01"), ("d2", "p1", "2026-01-02")], "doc_id string, person string, day string"), spark.createDataFrame([("d1", "X"), ("d1", "Y"), ("d2", "X")], "doc_id string, location string"))
    legs = features.call_legs(calls, features.first_owner(people, "phones")).unionByName(features.transfer_legs(paid, features.first_owner(people, "accounts"))).unionByName(seen)
    got = {r.person: r for r in features.person_features(people.withColumnRenamed("id", "person"), legs).collect()}
    assert (got["p1"].calls_per_day, got["p1"].unique_contacts, got["p1"].night_calls, got["p1"].average_call_duration) == (round(2 / 3, 2), 2, 1, 15)
    assert (got["p2"].calls_per_day, got["p2"].unique_contacts, got["p2"].transaction_count, got["p2"].transaction_amount) == (round(1 / 3, 2), 1, 1, 7)
    assert (got["p1"].transaction_count, got["p1"].transaction_amount, got["p1"].unique_locations, got["p1"].location_changes) == (2, 10, 2, 2)
    assert all(got["p3"][f] == 0 for f in features.FEATURES)
    assert tuple(features.medians(spark.createDataFrame(list(got.values()))).first())[:2] == (round(1 / 3, 2), 1)


def eight(spark, rows):
    return spark.createDataFrame([(f"p{i:03d}", *map(float, r)) for i, r in enumerate(rows)], "person string, " + ", ".join(f"{f} double" for f in features.FEATURES))


def test_isolation_forest(spark):
    rows = [[(i * k) % 7 for k in range(1, 9)] for i in range(200)] + [[500] * 8]
    got = {r.person: r for r in anomaly.isolation_forest(eight(spark, rows), trees=30).collect()}
    worst = max(got.values(), key=lambda r: r.anomaly)
    assert worst.person == "p200" and worst.anomaly == 1 and worst.severity == "HIGH" and "Communication spike" in worst.reasons and min(r.anomaly for r in got.values()) == 0
    assert {r.person: r.anomaly for r in anomaly.isolation_forest(eight(spark, rows), trees=30).collect()} == {k: r.anomaly for k, r in got.items()}
    assert anomaly.isolation_forest(eight(spark, rows[:1])).first().reasons == ["Insufficient data for anomaly detection (single entity)"]
    assert {r.anomaly for r in anomaly.isolation_forest(eight(spark, rows[:1] * 3)).collect()} == {0.0}
    assert anomaly.isolation_forest(eight(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        anomaly.isolation_forest(eight(spark, rows), contamination=0.6)


def test_latest_and_filtered(spark):
    rows = [("a", "1", 1, 0.9, "HIGH", "x; y"), ("a", "2", 1, 0.6, "MEDIUM", "z"), ("b", "1", 1, 0.7, "MEDIUM", "")]
    frame = spark.createDataFrame(rows, "entity_id string, created_at string, id long, score double, severity string, reason string")
    assert [(r.entity_id, r.reasons) for r in anomaly.filtered(frame).collect()] == [("b", []), ("a", ["z"])]
    assert [r.entity_id for r in anomaly.filtered(frame, severity="MEDIUM", min_score=0.65).collect()] == ["b"] and anomaly.filtered(frame, entity_id="a").count() == 1
    with pytest.raises(ValueError):
        anomaly.filtered(frame, severity="WORST")


def test_scoring_run_and_reports(spark):
    pairs = [("p1", "x1"), ("p2", "x1"), ("p2", "x2"), ("p3", "x2"), ("p4", "x2")]
    edges = spark.createDataFrame([(f"e{k}", a, b, "CALLED", f"2026-01-0{k + 1}T00:00:00Z", f"C{k}") for k, (a, b) in enumerate(pairs)] + [("e9", "p1", "p1", "OWNS", None, "C9")], "edge_id string, src string, dst string, type string, timestamp string, source string")
    nodes = spark.createDataFrame([(x,) for x in ("p1", "p2", "p3", "p4", "p5", "x1", "x2")], "id string")
    persons = nodes.filter("id like 'p%'").withColumnRenamed("id", "person")
    legs = features.call_legs(edges.filter("type = 'CALLED'").select(F.col("src").alias("caller"), F.col("dst").alias("receiver"), F.col("timestamp").alias("ts"), F.lit(5.0).alias("duration")))
    scores, results, run = analytics.run_analytics(nodes, edges, persons, legs, run_id="r1", created_at="2026")
    got = {r.id: r for r in scores.collect()}
    assert got["p2"].degree == 2 and got["p2"].betweenness == max(r.betweenness for r in got.values()) and got["p5"].degree == 0 and got["p2"].community is not None
    assert tuple(run.first())[2:5] == (7, 6, 5)
    ranked = reads.priorities(scores, results)
    top = reads.top_priorities(ranked, 2).collect()
    assert [r.id for r in top][0] == "p2" and top[0].priority_100 == round(top[0].priority * 100) and ranked.count() == 5
    entities = persons.select(F.col("person").alias("id"), F.lit("PERSON").alias("type"), F.when(F.col("person") == "p2", "Ann").otherwise(F.col("person")).alias("name"))
    mentions = spark.createDataFrame([("p2", "d1", 0.5), ("p2", "d2", 0.9)], "entity_id string, document_id string, confidence double")
    full = reads.reports(entities, scores, results, edges, mentions)
    report = {r.id: r for r in full.collect()}["p2"]
    assert [r.edge_id for r in report.key_relationships] == ["e1", "e2"] and report.sources == ["d2", "d1"] and report.timeline[0].description == "Ann —CALLED→ x1"
    text = {r.id: r.narrative for r in reads.narratives(full).collect()}
    assert text["p2"].startswith("Ann (p2) has ") and "2 key links, 2 source records, close-knit group" in text["p2"] and "key link" not in text["p5"]
    assert "Ann (p2) को" in {r.id: r.narrative for r in reads.narratives(full, "hi").collect()}["p2"]


def test_pages_and_lists(spark):
    entities = spark.createDataFrame([("i1", "PERSON", "Bob"), ("i2", "PERSON", "ann"), ("i3", "PHONE", "+91"), ("bo4", "PHONE", "x")], "id string, type string, name string")
    mentions = spark.createDataFrame([("i1", "d1", "Bobby", 0.5), ("i1", "d2", "Bob", 0.9), ("i2", "d1", "robot", 0.1)], "entity_id string, document_id string, text string, confidence double")
    items = reads.entity_items(entities, mentions)
    got = {r.id: r for r in items.collect()}
    assert got["i1"].aliases == ["Bobby"] and got["i1"].source_refs == ["d2", "d1"] and got["i1"].confidence == 0.9 and got["i3"].aliases == []
    assert sorted(r.id for r in reads.list_entities(items, q="BO").collect()) == ["i1", "i2"] and [r.id for r in reads.list_entities(items, kind="PHONE").orderBy("id").collect()] == ["bo4", "i3"]
    assert {r.id: r.match for r in reads.search(items, "bo").collect()} == {"i1": "name", "bo4": "id", "i2": "alias"}
    page, info = reads.page_of(items, reads.by_name(), 2, 3)
    assert [r.id for r in page.collect()] == ["bo4"] and info == {"page": 2, "page_size": 3, "total": 4, "total_pages": 2}
    assert [r.id for r in reads.page_of(items, reads.by_name(True), 1, 2)[0].collect()] == ["bo4", "i1"] and reads.page_of(items.limit(0), reads.by_name(), 1, 5)[1]["total_pages"] == 0
    assert reads.clamped_page(9, 11, 5) == (3, 3) and reads.clamped_page(0, 0, 5) == (1, 1)
    scores = spark.createDataFrame([("i1", 0.2, None), ("i3", 0.1, 0.9)], "id string, pagerank double, priority double")
    both = reads.with_scores(items, scores)
    assert [r.id for r in both.orderBy(*reads.directory_order("pagerank")).collect()] == ["i1", "i3", "bo4", "i2"] and [r.id for r in both.orderBy(*reads.directory_order("priority")).collect()][:2] == ["i3", "i1"]
    assert [r.id for r in reads.directory(items, q="bob", kind="PERSON").collect()] == ["i1"]
    for bad in (lambda: reads.search(items, "b"), lambda: reads.search(items, "b\x01c"), lambda: reads.list_entities(items, kind="CAT"), lambda: reads.page_of(items, [], 1, 101), lambda: reads.timeline(items, items, types={"PARTY"}), lambda: reads.link_check(items, ["a"])):
        with pytest.raises(ValueError):
            bad()
    assert {r.type: r.n for r in reads.count_by_type(spark.createDataFrame([("A",), (None,)], "type string")).collect()} == {"A": 1, "UNKNOWN": 1}
    assert sorted(tuple(r) for r in reads.first_of_each([entities.limit(1), entities.withColumn("name", F.lit("z"))], "id").select("id", "name").collect()) == [("bo4", "z"), ("i1", "Bob"), ("i2", "z"), ("i3", "z")]


def test_grid_and_stream(spark):
    moments = spark.createDataFrame([(dt.datetime(2026, 3, 1, 5),), (dt.datetime(2026, 3, 1, 6),), (dt.datetime(2025, 1, 1),)], "ts timestamp")
    grid = reads.weekly_grid(moments, F.lit(dt.date(2026, 3, 2)), weeks=1).collect()
    assert len(grid) == 7 and {r.day.day: r.n for r in grid if r.n} == {1: 2}
    events = spark.createDataFrame([(1, dt.datetime(2026, 3, 1, 5, 10), "view", 2.0), (1, dt.datetime(2026, 3, 1, 5, 50), "view", 3.0), (1, dt.datetime(2026, 3, 1, 5), "purchase", 9.0)], "user_id long, ts timestamp, event_type string, value double")
    assert [tuple(r) for r in streaming.hourly_calls(events).collect()] == [(dt.datetime(2026, 3, 1, 5), 1, 2, 5.0)]
