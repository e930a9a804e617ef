"""The investigation queries over the adapter views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inquiro.functions import normalize as N
from inquiro.operators import analytics, anomaly, audit, extract, features, graph, index, reads, resolve
from inquiro.plans import views as V
from inquiro.storage import materialize, shared_dir

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().upper().startswith("SELECT") else f"WITH RECURSIVE {V.SQL}, {sql}" if not sql.startswith("|") else f"WITH RECURSIVE {V.SQL} {sql[1:]}"
        return f

    return put


def _features(spark, d):
    return features.person_features(V.persons(spark, d), V.legs(spark, d))


_FEATURES = """
n AS (SELECT greatest(1, count(DISTINCT CAST(ts AS DATE))) AS days FROM ev),
c AS (SELECT caller AS person, round(count(*) / (SELECT days FROM n), 2) AS calls_per_day, CAST(count(DISTINCT receiver) AS DOUBLE) AS unique_contacts, round(CAST(sum(CAST(duration AS DECIMAL(18,4))) AS DOUBLE) / count(duration), 2) AS average_call_duration,
  CAST(count(*) FILTER (WHERE hour(ts) < 5) AS DOUBLE) AS night_calls FROM calls GROUP BY 1),
t AS (SELECT sender AS person, CAST(count(*) AS DOUBLE) AS transaction_count, round(CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE), 2) AS transaction_amount FROM transfers GROUP BY 1),
pl AS (SELECT person, location, lag(location) OVER (PARTITION BY person ORDER BY day, location) AS before FROM (SELECT DISTINCT * FROM places)),
l AS (SELECT person, CAST(count(DISTINCT location) AS DOUBLE) AS unique_locations, CAST(count(*) FILTER (WHERE before <> location) AS DOUBLE) AS location_changes FROM pl GROUP BY 1),
f AS (SELECT person, coalesce(calls_per_day, 0) AS calls_per_day, coalesce(unique_contacts, 0) AS unique_contacts, coalesce(average_call_duration, 0) AS average_call_duration, coalesce(night_calls, 0) AS night_calls,
  coalesce(transaction_count, 0) AS transaction_count, coalesce(transaction_amount, 0) AS transaction_amount, coalesce(unique_locations, 0) AS unique_locations, coalesce(location_changes, 0) AS location_changes
  FROM persons LEFT JOIN c USING (person) LEFT JOIN t USING (person) LEFT JOIN l USING (person))"""
_MEDIANS = ", ".join(f"median({x}) AS {x}" for x in features.FEATURES)


@query(f"{_FEATURES} SELECT * FROM f")
def features8(spark, d):
    return _features(spark, d)


@query(f"{_FEATURES} SELECT {_MEDIANS} FROM f")
def feature_medians(spark, d):
    return features.medians(_features(spark, d))


@query(
    f"""{_FEATURES}, m AS (SELECT {_MEDIANS} FROM f)
SELECT f.person, array_to_string(list_filter([
  CASE WHEN f.calls_per_day > 0 AND f.calls_per_day >= greatest(2.0, m.calls_per_day * 2) THEN 'Communication spike' END,
  CASE WHEN f.unique_contacts > 0 AND f.unique_contacts >= greatest(5.0, m.unique_contacts * 2) THEN 'High number of unique contacts' END,
  CASE WHEN f.night_calls > 0 AND f.night_calls >= greatest(3.0, m.night_calls * 2) THEN 'Unusual night-call activity' END,
  CASE WHEN f.transaction_amount > 0 AND f.transaction_amount >= greatest(100000.0, m.transaction_amount * 3) THEN 'Large transaction activity' END,
  CASE WHEN f.transaction_count > 0 AND f.transaction_count >= greatest(5.0, m.transaction_count * 2) THEN 'Unusual transaction frequency' END,
  CASE WHEN f.location_changes > 0 AND f.location_changes >= greatest(3.0, m.location_changes * 2) THEN 'Unusual location changes' END,
  CASE WHEN f.unique_locations > 0 AND f.unique_locations >= greatest(4.0, m.unique_locations * 2) THEN 'High location diversity' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM f, m"""
)
def anomaly_reasons(spark, d):
    return features.with_reasons(_features(spark, d)).select("person", F.array_join("reasons", "; ").alias("reasons"))


_SUM = " + ".join(f"(rank() OVER (ORDER BY {x}) - 1) / greatest(1, (SELECT count(*) FROM f) - 1)::DOUBLE" for x in features.FEATURES)


@query(f"{_FEATURES} SELECT person, round(({_SUM}) / 8, 6) AS anomaly FROM f")
def anomaly_surrogate(spark, d):
    return features.surrogate_scores(_features(spark, d))


@query()
def iforest(spark, d):
    return anomaly.isolation_forest(_features(spark, d))


_ADJ = "e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst), adj AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"


def _graph(spark, d):
    e = materialize(V.edges(spark, d).select("src", "dst").distinct())  # far fewer than events
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes, graph.adjacency(e)


@query(f"{_ADJ} SELECT a, b FROM adj")
def adjacency(spark, d):
    return _graph(spark, d)[1]


@query(f"{_ADJ} SELECT id, count(a) AS degree FROM nodes LEFT JOIN adj ON a = id GROUP BY id")
def degree(spark, d):
    return graph.degrees(*_graph(spark, d))


def _pagerank_sql(k: int) -> str:
    steps = ["dg AS (SELECT a, count(*) AS deg FROM adj GROUP BY a), nn AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM nodes, nn)"]
    for i in range(k):
        steps.append(f"r{i + 1} AS (SELECT nodes.id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(g.got, 0) AS r FROM nodes CROSS JOIN nn LEFT JOIN (SELECT b, sum(r / deg) AS got FROM adj JOIN dg USING (a) JOIN r{i} ON r{i}.id = adj.a GROUP BY b) g ON g.b = nodes.id)")
    return ", ".join(steps)


@query(f"{_ADJ}, {_pagerank_sql(10)} SELECT id, round(r / (SELECT sum(r) FROM r10), 8) AS pagerank FROM r10")
def pagerank_k10(spark, d):
    return graph.pagerank(*_graph(spark, d), rounds=10, tolerance=0.0).select("id", F.round("pagerank", 8).alias("pagerank"))


@query()
def pagerank_minmax(spark, d):
    return graph.minmax(graph.pagerank(*_graph(spark, d)), "pagerank")


def _betweenness_sql(levels: int) -> str:
    """Shortest paths from all nodes, level by level there and back."""
    steps = ["l0 AS MATERIALIZED (SELECT id AS s, id AS v, 1.0::DOUBLE AS p FROM nodes)"]
    for i in range(levels):
        before = f"SELECT s, v FROM l{i}" + (f" UNION ALL SELECT s, v FROM l{i - 1}" if i else "")
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT l.s, adj.b AS v, sum(l.p) AS p FROM l{i} l JOIN adj ON adj.a = l.v WHERE (l.s, adj.b) NOT IN ({before}) GROUP BY 1, 2)")
    steps.append(f"b{levels} AS MATERIALIZED (SELECT s, v, p, 0.0::DOUBLE AS x FROM l{levels})")
    for i in range(levels - 1, 0, -1):
        steps.append(f"b{i} AS MATERIALIZED (SELECT l.s, l.v, l.p, l.p * coalesce(g.y, 0) AS x FROM l{i} l LEFT JOIN (SELECT b.s, adj.b AS v, sum((1 + b.x) / b.p) AS y FROM b{i + 1} b JOIN adj ON adj.a = b.v GROUP BY 1, 2) g ON g.s = l.s AND g.v = l.v)")
    union = " UNION ALL ".join(f"SELECT v, x FROM b{i}" for i in range(1, levels + 1))
    steps.append(f"bw AS (SELECT nodes.id, coalesce(sum(t.x), 0) / nullif((SELECT (count(*) - 1) * (count(*) - 2) FROM nodes), 0)::DOUBLE AS w FROM nodes LEFT JOIN ({union}) t ON t.v = nodes.id GROUP BY nodes.id)")
    return ", ".join(steps)


@query(f"{_ADJ}, {_betweenness_sql(5)} SELECT id, round(w, 8) AS betweenness FROM bw")
def betweenness(spark, d):
    return graph.betweenness(*_graph(spark, d)).select("id", F.round("betweenness", 8).alias("betweenness"))


@query()
def betweenness_sampled(spark, d):
    """Betweenness within 0.05 with probability 0.9, from sampled paths."""
    return graph.sampled_betweenness(*_graph(spark, d), error=0.05)


@query()
def louvain(spark, d):
    return graph.communities(*_graph(spark, d))


@query(f"{_ADJ}, cc AS (SELECT id, id AS root FROM nodes UNION SELECT adj.b, cc.root FROM cc JOIN adj ON adj.a = cc.id) SELECT id, min(root) AS component FROM cc GROUP BY id")
def components(spark, d):
    nodes, adj = _graph(spark, d)
    return graph.components(adj, nodes)


def _hops(depth: int) -> str:
    return f"{_ADJ}, h AS (SELECT 'U1' AS id, 0 AS dist UNION SELECT adj.b, h.dist + 1 FROM h JOIN adj ON adj.a = h.id WHERE h.dist < {depth}) SELECT id, min(dist) AS dist FROM h GROUP BY id"


@query(_hops(1))
def neighborhood_d1(spark, d):
    return graph.neighborhood(V.edges(spark, d), "U1", 1)


@query(_hops(2))
def neighborhood_d2(spark, d):
    return graph.neighborhood(V.edges(spark, d), "U1", 2)


@query(_hops(1).replace("FROM edges WHERE src <> dst", "FROM edges WHERE src <> dst AND type = 'TRANSFERRED_TO'"))
def neighborhood_typed(spark, d):
    return graph.neighborhood(V.edges(spark, d), "U1", 1, ["TRANSFERRED_TO"])


_IDS = "('U1', 'U2', 'K3', 'U4')"


@query(
    f"""| , e AS (SELECT src AS owner, dst AS contact FROM edges UNION SELECT dst, src FROM edges), m AS (SELECT DISTINCT owner, contact FROM e WHERE owner IN {_IDS} AND contact NOT IN {_IDS})
SELECT contact, array_to_string(list_sort(list(owner)), '; ') AS owners FROM m GROUP BY contact HAVING count(*) >= 2"""
)
def link_check(spark, d):
    """Contacts that two or more of four entities share."""
    shared = reads.link_check(_with_ids(V.edges(spark, d)), ["U1", "U2", "K3", "U4"])[1]
    return shared.select("contact", F.array_join("owners", "; ").alias("owners"))


@query(f"| SELECT src, dst, type, source FROM edges WHERE src IN {_IDS} AND dst IN {_IDS} AND src <> dst")
def link_check_direct(spark, d):
    return reads.link_check(_with_ids(V.edges(spark, d)), ["U1", "U2", "K3", "U4"])[0].select("src", "dst", "type", "source")


def _with_ids(edges):
    return edges.withColumn("edge_id", N.edge_id(F.col("src"), F.col("type"), F.col("dst"), F.col("source")))


@query("| SELECT src, dst, type, concat('rel_', substr(sha256(concat_ws('|', src, type, dst, source)), 1, 16)) AS edge_id FROM edges")
def edge_ids(spark, d):
    return V.edges(spark, d).select("src", "dst", "type", N.edge_id(F.col("src"), F.col("type"), F.col("dst"), F.col("source")).alias("edge_id"))


@query("| SELECT concat('rel_', substr(sha256(concat_ws('|', src, type, dst, source)), 1, 16)) AS edge_id FROM edges WHERE type = 'TRANSFERRED_TO'")
def merge_new_edges(spark, d):
    e = V.edges(spark, d).withColumn("edge_id", N.edge_id(F.col("src"), F.col("type"), F.col("dst"), F.col("source"))).select("edge_id", "src", "dst", "type", "source")
    return graph.merge_edges(e.filter("type = 'CALLED'"), e).select("edge_id")


_NAMED = "names AS (SELECT person AS id, concat('Person ', person) AS name FROM persons)"
_DATED = "dated AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t FROM edges)"


def _dated(spark, d):
    return _with_ids(V.edges(spark, d)).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def _named(spark, d):
    return V.persons(spark, d).select(F.col("person").alias("id"), F.concat(F.lit("Person "), "person").alias("name"))


@query(
    f"""| , {_NAMED}, {_DATED}, s AS (SELECT src AS entity_id, dst AS other, type, t, source FROM dated UNION ALL SELECT dst, src, type, t, source FROM dated WHERE src <> dst)
SELECT entity_id, t AS timestamp, CASE type WHEN 'CALLED' THEN 'CALL' ELSE 'TRANSACTION' END AS type, concat(coalesce(a.name, entity_id), ' —', type, '→ ', coalesce(b.name, other)) AS description, source AS source_id FROM s LEFT JOIN names a ON a.id = entity_id LEFT JOIN names b ON b.id = other"""
)
def timeline(spark, d):
    """Every entity's events."""
    return reads.timeline(_dated(spark, d), _named(spark, d)).drop("edge_id")


@query(
    f"""| , {_NAMED}, {_DATED}, s AS (SELECT src AS entity_id, dst AS other, type, t, source FROM dated UNION ALL SELECT dst, src, type, t, source FROM dated WHERE src <> dst),
lim AS (SELECT min(t) AS lo, max(t) AS hi FROM dated)
SELECT entity_id, t AS timestamp, 'TRANSACTION' AS type, concat(coalesce(a.name, entity_id), ' —', type, '→ ', coalesce(b.name, other)) AS description, source AS source_id FROM s LEFT JOIN names a ON a.id = entity_id LEFT JOIN names b ON b.id = other, lim
WHERE type = 'TRANSFERRED_TO' AND substr(t, 1, 10) > substr(lo, 1, 10) AND substr(t, 1, 10) < substr(hi, 1, 10)"""
)
def timeline_filtered(spark, d):
    """Transfers between the first and the last day, both left out."""
    e = _dated(spark, d)
    lo, hi = e.agg(F.date_format(F.date_add(F.to_date(F.min("ts")), 1), "yyyy-MM-dd"), F.date_format(F.max("ts"), "yyyy-MM-dd")).first()
    return reads.timeline(e, _named(spark, d), start=lo, end=hi, types={"TRANSACTION"}).drop("edge_id")


@query("| SELECT person, contact, count(*) AS legs, round(CAST(sum(CAST(duration AS DECIMAL(18,4))) AS DOUBLE), 4) AS total FROM (SELECT caller AS person, receiver AS contact, duration FROM calls UNION ALL SELECT receiver, caller, duration FROM calls) GROUP BY 1, 2")
def call_legs(spark, d):
    return features.call_legs(V.calls(spark, d)).groupBy("person", "contact").agg(F.count("*").alias("legs"), F.round(F.sum("duration").cast("double"), 4).alias("total"))


@query("| SELECT DISTINCT person, day, location FROM places")
def loc_obs(spark, d):
    return V.places(spark, d).distinct()


@query("| SELECT type, normalized, n, row_number() OVER (PARTITION BY type ORDER BY first, normalized) AS seq FROM (SELECT type, lower(name) AS normalized, count(*) AS n, min(id) AS first FROM entities GROUP BY 1, 2)")
def resolve_exact(spark, d):
    m = V.entities(spark, d).select("type", F.col("name").alias("text"), F.col("id").alias("seen"))
    return resolve.resolve_exact(m).select("type", "normalized", "n", "seq")


@query()
def resolve_fuzzy(spark, d):
    """Customers whose names are alike and whose accounts lie within a hundred."""
    e = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("PERSON").alias("type"), F.col("c_name").alias("name"), F.array(F.floor(F.col("c_acctbal") / 100).cast("string")).alias("evidence"))
    return resolve.fuzzy_matches(e)


_ITEMS = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, document_id) AS k FROM mentions) WHERE k <= 100),
said AS (SELECT entity_id, list_sort(list(DISTINCT text)) AS texts, list(document_id ORDER BY k) AS refs, max(confidence) AS confidence FROM top GROUP BY 1),
items AS (SELECT id, type, name, array_to_string(list_filter(coalesce(texts, []), lambda x: x <> name), '; ') AS aliases, array_to_string(refs, '; ') AS source_refs, confidence FROM entities LEFT JOIN said ON entity_id = id)"""


def _items(spark, d):
    return reads.entity_items(V.entities(spark, d), V.mentions(spark, d))


def _flat(items):
    return items.select("id", "type", "name", F.array_join("aliases", "; ").alias("aliases"), F.array_join(F.col("source_refs").cast("array<string>"), "; ").alias("source_refs"), "confidence")


@query(f"| , {_ITEMS} SELECT * FROM items")
def entity_list(spark, d):
    return _flat(_items(spark, d))


@query(f"| , {_ITEMS} SELECT * FROM items WHERE type = 'PERSON' AND (lower(name) LIKE '%007%' OR lower(aliases) LIKE '%007%') ORDER BY lower(name) DESC, id DESC LIMIT 20")
def entity_list_filtered(spark, d):
    """The last page's worth of persons with 007 in name or alias (the feature)."""
    found = reads.list_entities(_items(spark, d), kind="PERSON", q="007")
    return _flat(reads.page_of(found, reads.by_name(descending=True), 1, 20)[0])


@query(f"| , {_ITEMS} SELECT id, type, name, CASE WHEN lower(name) LIKE '%high%' THEN 'name' WHEN lower(id) LIKE '%high%' THEN 'id' ELSE 'alias' END AS match FROM items WHERE lower(name) LIKE '%high%' OR lower(id) LIKE '%high%' OR lower(aliases) LIKE '%high%'")
def entity_search(spark, d):
    """By name, id or alias."""
    return reads.search(_items(spark, d), " High ")


@query(f"| , {_ITEMS} SELECT id, type, name, CASE WHEN lower(name) LIKE '%high%' THEN 'name' WHEN lower(id) LIKE '%high%' THEN 'id' ELSE 'alias' END AS match FROM items WHERE lower(name) LIKE '%high%' OR lower(id) LIKE '%high%' OR lower(aliases) LIKE '%high%'")
def entity_search_indexed(spark, d):
    """The same from postings of letter groups, written beforehand."""
    items, path = _items(spark, d), shared_dir(spark)
    index.write_index(items, path, F.col("name"), F.col("id"), F.array_join("aliases", "\n"))
    return reads.search(items.join(index.candidates(spark, path, "high"), "id", "left_semi"), " High ")


@query(f"| , {_ITEMS} SELECT id, type, name FROM items WHERE contains(lower(concat_ws(' ', name, id, replace(aliases, '; ', ' '))), 'urgent') AND type = 'PERSON'")
def directory_filtered(spark, d):
    return reads.directory(_items(spark, d), q="urgent", kind="PERSON").select("id", "type", "name")


@query("| SELECT entity_id, document_id, text, confidence, CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY document_id DESC) AS rn FROM mentions) WHERE rn = 1 AND confidence >= 0.5 AND confidence < 0.8 AND confidence >= 0.6")
def anomaly_filtered(spark, d):
    """Latest result of each entity, of one severity and a least score."""
    m = V.mentions(spark, d).select("entity_id", F.col("document_id").alias("id"), F.lit("t").alias("created_at"), F.col("confidence").alias("score"), N.severity(F.col("confidence")).alias("severity"), F.col("text").alias("reason"))
    got = anomaly.filtered(m, severity="MEDIUM", min_score=0.6)
    return got.select("entity_id", F.col("id").alias("document_id"), F.array_join("reasons", "; ").alias("text"), F.col("score").alias("confidence"), "severity")


@query("| SELECT entity_id, document_id, text, confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, document_id DESC) AS rn FROM mentions) WHERE rn = 1")
def anomaly_latest(spark, d):
    m = V.mentions(spark, d).select("entity_id", F.col("document_id").alias("id"), "text", F.col("confidence").alias("created_at"))
    return anomaly.latest(m).select("entity_id", F.col("id").alias("document_id"), "text", F.col("created_at").alias("confidence"))


_SCORES = f"""{_FEATURES}, {_ADJ}, {_pagerank_sql(10)}, {_betweenness_sql(5)}, s AS (SELECT person, round(({_SUM}) / 8, 6) AS an FROM f),
p AS (SELECT id, round((r - min(r) OVER ()) / nullif(max(r) OVER () - min(r) OVER (), 0), 6) AS pr FROM r10),
sc AS (SELECT s.person, p.pr, round(bw.w, 6) AS bw, s.an, round(0.35 * coalesce(p.pr, 0) + 0.35 * coalesce(round(bw.w, 6), 0) + 0.30 * s.an, 4) AS priority FROM s LEFT JOIN p ON p.id = s.person LEFT JOIN bw ON bw.id = s.person)"""


def _measures(spark, d):
    """(pagerank after ten rounds, from 0 to 1; betweenness), to six places."""
    nodes, adj = _graph(spark, d)
    nodes, adj = materialize(nodes), materialize(adj)
    ready = graph.prepared(nodes, adj)
    pr = graph.minmax(graph.pagerank(nodes, adj, rounds=10, tolerance=0.0, ready=ready), "pagerank").select("id", F.round("pagerank", 6).alias("pagerank"))
    return pr, graph.betweenness(nodes, adj, ready=ready).select("id", F.round("betweenness", 6).alias("betweenness"))


@query(f"{_SCORES} SELECT person, row_number() OVER (ORDER BY priority DESC, person) AS rank, priority, CAST(round(priority * 100) AS INTEGER) AS priority_100 FROM sc")
def priority_rank(spark, d):
    """Persons by review priority. The anomaly part is the surrogate and
    PageRank is cut at ten rounds, so that SQL can say it; analytics_run has
    the full form."""
    return analytics.ranked(*_measures(spark, d), features.surrogate_scores(_features(spark, d)))


def _run(spark, d):
    nodes, _ = _graph(spark, d)
    return analytics.run_analytics(nodes, V.edges(spark, d), V.persons(spark, d), V.legs(spark, d))


@query()
def analytics_run(spark, d):
    """A whole scoring run: converged PageRank, betweenness, communities and
    the isolation forest."""
    scores, results, _ = _run(spark, d)
    out = reads.priorities(scores, results)
    return out.withColumn("reasons", F.array_join("reasons", "; "))


@query(f"{_SCORES} SELECT person FROM (SELECT person, row_number() OVER (ORDER BY pr DESC, person) AS k FROM sc) WHERE k <= 20")
def metric_ranking(spark, d):
    """The first page by PageRank (the feature)."""
    pr, bw = _measures(spark, d)
    rows = V.persons(spark, d).select(F.col("person").alias("id")).join(pr, "id").join(bw, "id")
    return reads.page_of(rows, reads.metric_order("pagerank"), 1, 20)[0].select(F.col("id").alias("person"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def doc_hash_dedupe(spark, d):
    return V.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\+91[\s\-]?\(?\d{5}\)?[\s\-]?\d{5}')) AS raw FROM documents")
def extract_phones(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(extract.PATTERNS[0][1]), F.lit(0))).alias("raw"))


@query()
def extract_values(spark, d):
    return extract.extract_values(V.table(spark, d, "documents").select("doc_id", "text"))


@query()
def extract_spans(spark, d):
    return extract.extract_spans(V.table(spark, d, "documents").select("doc_id", "text"))


@query("SELECT c_custkey AS id, trim(regexp_replace(c_name, '\\s+', ' ', 'g')) AS display, lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) AS key FROM customer")
def norm_whitespace(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), N.whitespace(F.col("c_name")).alias("display"), N.name_key(F.col("c_name")).alias("key"))


@query("SELECT o_orderkey AS id, concat('+91', lpad(CAST(o_orderkey + 9000000000 AS VARCHAR), 10, '0')) AS phone FROM orders")
def norm_phone(spark, d):
    raw = F.concat(F.lit("91-"), (F.col("o_orderkey") + 9000000000).cast("string"))
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), N.phone(raw).alias("phone"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def norm_timestamp(spark, d):
    raw = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), N.timestamp(raw).alias("ts"), N.date(raw).alias("day"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS amount FROM customer")
def norm_amount(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), N.amount(F.col("c_acctbal").cast("string")).alias("amount"))


@query("| SELECT CAST(ts AS DATE) AS day, hour(ts) AS hr, count(*) AS n FROM ev GROUP BY 1, 2")
def activity_grid(spark, d):
    return V.table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.hour("ts").cast("long").alias("hr")).agg(F.count("*").alias("n"))


@query("| SELECT type, count(*) AS n FROM entities GROUP BY 1")
def count_by_type(spark, d):
    return V.entities(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query("| SELECT a.src AS person, count(DISTINCT b.dst) AS reach FROM edges a JOIN (SELECT DISTINCT dst AS mid, src AS dst FROM edges) b ON a.dst = b.mid AND a.src <> b.dst GROUP BY 1")
def bridge_reach(spark, d):
    """How many others share a contact with a person. Contacts with the same
    persons count once, and a person's reach is the size of a union of bit
    sets of person numbers: a popular contact is one set, never the square of
    its persons."""
    return graph.shared_contact_reach(V.edges(spark, d).select(F.col("src").alias("person"), F.col("dst").alias("contact")))


@query("""SELECT o_orderkey AS seq, sha256(concat('{"action":"', o_orderstatus, '","actor":"', o_custkey, '"}')) AS digest FROM orders""")
def audit_digest(spark, d):
    """Canonical digest of each order's actor and action."""
    o = V.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), audit.digest({"actor": F.col("o_custkey").cast("string"), "action": F.col("o_orderstatus")}).alias("digest"))


def _stored_log(spark, d):
    """Orders as an audit log in links of two: each even row starts from
    GENESIS as its predecessor's stored hash says, each odd row follows it."""
    o = V.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.col("o_custkey").cast("string").alias("actor"), F.col("o_orderstatus").alias("action"), F.col("o_orderpriority").alias("target"))
    first = audit.event_hash({"prev_hash": F.lit(audit.GENESIS), **{c: F.col(c) for c in ("created_at", "actor", "action", "target")}})
    log = o.withColumns({"seq": F.col("o_orderkey"), "id": F.concat(F.lit("audit_"), F.col("o_orderkey").cast("string")), "prev_hash": F.lit(audit.GENESIS), "hash": first})
    return log.select("seq", "id", "created_at", "actor", "action", "target", F.lit("").alias("input_hash"), F.lit("").alias("output_hash"), "prev_hash", "hash")


_EVENT = """ev2 AS (SELECT o_orderkey AS seq, sha256(concat('GENESIS', '{"action":"', o_orderstatus, '","actor":"', o_custkey, '","created_at":"', strftime(o_orderdate, '%Y-%m-%d'), '","input_hash":"","output_hash":"","prev_hash":"GENESIS","target":"', o_orderpriority, '"}')) AS hash FROM orders)"""


@query(f"WITH {_EVENT} SELECT seq, 'audit_' || seq AS id, hash, seq = (SELECT min(seq) FROM ev2) AS ok FROM ev2".replace("WITH ", "SELECT * FROM (WITH ", 1) + ")")
def audit_rows(spark, d):
    """A log in which each row claims to be the first: only one is."""
    return audit.check_rows(_stored_log(spark, d))


@query(f"SELECT * FROM (WITH {_EVENT} SELECT count(*) <= 1 AS verified, count(*) AS count, max_by(hash, seq) AS head_hash, 'audit_' || (SELECT min(seq) FROM ev2 WHERE seq > (SELECT min(seq) FROM ev2)) AS broken_at FROM ev2)")
def audit_verify(spark, d):
    return audit.verify_chain(_stored_log(spark, d))


_CHAIN = """o AS (SELECT o_custkey AS log, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, concat('","created_at":"', strftime(o_orderdate, '%Y-%m-%d'), '","input_hash":"","output_hash":"","prev_hash":"') AS a,
  concat('{"action":"', o_orderstatus, '","actor":"', o_custkey) AS b, concat('","target":"', o_orderpriority, '"}') AS c FROM orders),
chain AS (SELECT log, seq, k, 'GENESIS' AS prev_hash, sha256(concat('GENESIS', b, a, 'GENESIS', c)) AS hash FROM o WHERE k = 1
  UNION ALL SELECT o.log, o.seq, o.k, chain.hash, sha256(concat(chain.hash, o.b, o.a, chain.hash, o.c)) FROM chain JOIN o ON o.log = chain.log AND o.k = chain.k + 1)"""


def _logs(spark, d):
    """A log for each customer, an event for each order."""
    o = V.table(spark, d, "orders")
    text = {"id": F.concat(F.lit("audit_"), F.col("o_orderkey").cast("string")), "created_at": F.date_format("o_orderdate", "yyyy-MM-dd"), "actor": F.col("o_custkey").cast("string"), "action": F.col("o_orderstatus"), "target": F.col("o_orderpriority"), "input_hash": F.lit(""), "output_hash": F.lit("")}
    return audit.append_events(o.select(F.col("o_custkey").alias("log"), F.col("o_orderkey").alias("seq"), *[c.alias(k) for k, c in text.items()]))


@query(f"SELECT * FROM (WITH RECURSIVE {_CHAIN} SELECT log, seq, prev_hash, hash FROM chain)")
def audit_append(spark, d):
    """The chained events of all logs."""
    return _logs(spark, d).select("log", "seq", "prev_hash", "hash")


@query(
    f"""SELECT * FROM (WITH RECURSIVE {_CHAIN}, n AS (SELECT log, count(*) AS n, max_by(hash, k) AS head_hash, max(CASE WHEN k = 2 THEN seq END) AS second FROM chain GROUP BY log)
SELECT log, NOT (log % 7 = 0 AND n > 1) AS verified, n AS count, head_hash, CASE WHEN log % 7 = 0 AND n > 1 THEN concat('audit_', second) END AS broken_at FROM n)"""
)
def audit_verify_logs(spark, d):
    """Each customer's log, verified; every seventh had its second event's
    actor changed."""
    made = _logs(spark, d)
    at = F.row_number().over(Window.partitionBy("log").orderBy("seq"))
    touched = made.withColumn("k", at).withColumn("actor", F.when((F.col("log") % 7 == 0) & (F.col("k") == 2), "someone").otherwise(F.col("actor"))).drop("k")
    return audit.verify_logs(touched)
