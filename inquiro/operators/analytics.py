"""One scoring run: graph measures, communities, features, anomaly, priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquiro.functions import normalize as N
from inquiro.operators import anomaly, features, graph, reads
from inquiro.storage import materialize


def run_analytics(nodes: DataFrame, edges: DataFrame, persons: DataFrame, legs: DataFrame, *, run_id: str = "run", created_at: str = "", betweenness_error: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, results, run) of nodes(id), edges(src, dst, type),
    persons(person) and activity legs.

    scores has id, degree, pagerank, betweenness, community of each person
    (zero if the graph lacks it); results the anomaly rows as they are kept;
    run one row with counts, methods and the window in days. Exact betweenness
    takes nodes x edges steps; betweenness_error takes sampled paths instead.
    """
    adj = materialize(graph.adjacency(edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")))
    nodes = materialize(nodes.select("id").distinct())
    people = materialize(persons.select("person").distinct())
    measured = graph.analyze(nodes, adj, betweenness_error).join(graph.communities(nodes, adj), "id")
    scores = people.select(F.col("person").alias("id")).join(measured, "id", "left")
    scores = scores.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("degree", "pagerank", "betweenness")], "community", F.lit(run_id).alias("run_id"), F.lit(created_at).alias("updated_at"))
    eight = materialize(features.person_features(people, legs))
    found = anomaly.isolation_forest(eight)
    reason = F.when(F.size("reasons") > 0, F.array_join("reasons", "; ")).otherwise(reads.NO_SIGNAL)
    results = found.select(F.concat(F.lit(f"{run_id}:"), "person").alias("id"), F.col("person").alias("entity_id"), F.col("anomaly").alias("score"), "severity", reason.alias("reason"), "model_version", F.lit(created_at).alias("created_at")).join(eight.withColumnRenamed("person", "entity_id"), "entity_id")
    days = legs.join(people, "person", "left_semi").agg(F.greatest(F.lit(1), F.count_distinct("day")).alias("window_days"))
    counts = nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count"))).crossJoin(days)  # one row each
    methods = F.create_map(*[F.lit(x) for kv in {"centrality": "degree/pagerank/brandes-undirected" if betweenness_error is None else f"degree/pagerank/sampled-paths({betweenness_error})", "communities": "louvain", "anomaly": anomaly.MODEL, "scoring": "v1"}.items() for x in kv])
    run = counts.select(F.lit(run_id).alias("run_id"), F.lit(created_at).alias("created_at"), "node_count", "edge_count", "window_days", methods.alias("methods"))
    return scores, results, run


def ranked(pagerank: DataFrame, betweenness: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(person, rank, priority, priority_100): pagerank and betweenness by id,
    anomalies(person, anomaly); ranks by priority, then id."""
    from inquiro.operators.numbering import numbered

    both = anomalies.join(pagerank.withColumnRenamed("id", "person"), "person", "left").join(betweenness.withColumnRenamed("id", "person"), "person", "left")
    at = (F.coalesce("pagerank", F.lit(0.0)), F.coalesce("betweenness", F.lit(0.0)), F.col("anomaly"))
    scored = both.select("person", N.priority(*at).alias("priority"), N.priority_100(*at).alias("priority_100"))
    return numbered(scored, F.desc("priority"), F.col("person"), name="rank").select("person", "rank", "priority", "priority_100")
