"""Narratives, call records and the reads that serve an investigator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inquiro.functions import normalize as N
from inquiro.operators import extract, features, graph, reads, resolve
from inquiro.plans import views as V
from inquiro.plans.queries import _ADJ, _DATED, _FEATURES, _ITEMS, _NAMED, _SCORES, _dated, _features, _graph, _hops, _items, _measures, _named, query
from inquiro.sources import files

_PARTS = """parts AS (SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS d, concat(CASE WHEN o_orderkey % 2 = 0 THEN '+91' ELSE '' END, o_orderkey + 9000000000) AS p, concat('NATION_', o_custkey % 25) AS l,
  concat('ACC', lpad(CAST(o_custkey % 1000000 AS VARCHAR), 6, '0')) AS a, concat('DL', lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0'), 'AB', lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')) AS v FROM orders)"""


@query("SELECT p_partkey AS id, concat('DL', lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0'), 'AB', lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0')) AS plate FROM part")
def norm_vehicle(spark, d):
    k = F.col("p_partkey")
    raw = F.concat(F.lit("dl-"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" ab "), F.lpad((k % 10000).cast("string"), 4, "0"))
    return V.table(spark, d, "part").select(k.alias("id"), N.vehicle(raw).alias("plate"))


@query("SELECT s_suppkey AS id, concat('ACC', lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS account FROM supplier")
def norm_account(spark, d):
    raw = F.concat(F.lit("acc "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    return V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), N.account(raw).alias("account"))


_BAD = f"""{_PARTS}, rc AS (SELECT event_id AS i, event_type = 'purchase' AS paid FROM ev), bad AS (
SELECT 'CDR' AS dataset, concat('CDR_', i) AS id, 'caller' AS field, 'INVALID_PHONE_NUMBER' AS code FROM rc WHERE NOT paid AND i % 50 = 0 AND i % 70 <> 0
UNION ALL SELECT 'CDR', concat('CDR_', i), 'timestamp', 'MISSING_REQUIRED_FIELD' FROM rc WHERE NOT paid AND i % 70 = 0
UNION ALL SELECT 'TRANSACTION', concat(CASE WHEN i % 60 = 0 THEN 'TXN #' ELSE 'TXN_' END, i), 'currency', 'MISSING_REQUIRED_FIELD' FROM rc WHERE paid AND i % 45 = 0
UNION ALL SELECT 'TRANSACTION', concat('TXN #', i), 'transaction_id', 'INVALID_RECORD_STRUCTURE' FROM rc WHERE paid AND i % 60 = 0
UNION ALL SELECT 'TRANSACTION', concat('TXN_', i), 'amount', 'INVALID_NUMERIC_VALUE' FROM rc WHERE paid AND i % 40 = 0 AND i % 60 <> 0 AND i % 45 <> 0
UNION ALL SELECT 'VEHICLE', concat('V', p_partkey), 'owner_name', 'MISSING_REQUIRED_FIELD' FROM part WHERE p_partkey % 35 = 0
UNION ALL SELECT 'VEHICLE', concat('V', p_partkey), 'registration_number', 'INVALID_VEHICLE_NUMBER' FROM part WHERE p_partkey % 30 = 0 AND p_partkey % 35 <> 0
UNION ALL SELECT 'LOCATION', concat('LOC_', s_suppkey), 'name', 'MISSING_REQUIRED_FIELD' FROM supplier WHERE s_suppkey % 11 = 0
UNION ALL SELECT 'LOCATION', concat('LOC_', s_suppkey), 'latitude', 'INVALID_NUMERIC_VALUE' FROM supplier WHERE s_suppkey % 9 = 0 AND s_suppkey % 11 <> 0
UNION ALL SELECT 'LOCATION', concat('LOC_', s_suppkey), 'longitude', 'INVALID_NUMERIC_VALUE' FROM supplier WHERE s_suppkey % 10 = 0 AND s_suppkey % 11 <> 0
UNION ALL SELECT 'FIR', concat('FIR_', doc_id), 'text', 'MISSING_REQUIRED_FIELD' FROM parts WHERE doc_id % 21 = 0
UNION ALL SELECT 'FIR', concat('FIR_', doc_id), 'date', 'INVALID_TIMESTAMP' FROM parts WHERE doc_id % 20 = 0 AND doc_id % 21 <> 0),
counts AS (SELECT 'CDR' AS dataset, count(*) AS n FROM rc WHERE NOT paid UNION ALL SELECT 'TRANSACTION', count(*) FROM rc WHERE paid UNION ALL SELECT 'VEHICLE', count(*) FROM part UNION ALL SELECT 'LOCATION', count(*) FROM supplier UNION ALL SELECT 'FIR', count(*) FROM parts)"""


def _standard(spark, d):
    return {k: files.standardize(records(spark, d), k) for k, records in V.RECORDS.items()}


@query(f"{_BAD} SELECT * FROM bad")
def norm_record_errors(spark, d):
    """Field errors of records of all five kinds, with planted faults."""
    each = [files.split_records(s)[1].select(F.lit(k).alias("dataset"), F.col("original")[files.ID_FIELD[k]].alias("id"), "field", "code") for k, s in _standard(spark, d).items()]
    return reduce(DataFrame.unionByName, each)


@query(f"{_BAD} SELECT c.dataset, n - count(DISTINCT id) AS valid_count, count(id) AS invalid_count, greatest(0, count(id) - 50) AS truncated_errors, CASE WHEN n = count(DISTINCT id) THEN 'FAILED' WHEN count(id) > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status FROM counts c LEFT JOIN bad b ON b.dataset = c.dataset GROUP BY c.dataset, n")
def ingest_status(spark, d):
    return reduce(DataFrame.unionByName, [files.run_status(s).select(F.lit(k).alias("dataset"), "*") for k, s in _standard(spark, d).items()])


@query(f"{_BAD} SELECT concat('LOC_', s_suppkey) AS source_id, concat('Place ', s_suppkey % 25) AS name, concat('place ', s_suppkey % 25) AS name_normalized, (s_suppkey % 90)::DOUBLE AS latitude, (s_suppkey % 180)::DOUBLE AS longitude FROM supplier WHERE concat('LOC_', s_suppkey) NOT IN (SELECT id FROM bad)")
def norm_locations(spark, d):
    """Valid places, normalized, with their match key."""
    return files.split_records(_standard(spark, d)["LOCATION"])[0].select("source_id", "normalized.name", "normalized.name_normalized", "normalized.latitude", "normalized.longitude")


@query(f"{_BAD} SELECT concat('FIR_', doc_id) AS source_id, d AS date, 'WEB' AS source FROM parts WHERE doc_id % 20 <> 0 AND doc_id % 21 <> 0")
def norm_reports(spark, d):
    return files.split_records(_standard(spark, d)["FIR"])[0].select("source_id", "normalized.date", "normalized.source")


_PERSONS = "own AS (SELECT person, concat('+91', CAST(substr(person, 2) AS BIGINT) + 9000000000) AS phone FROM persons)"
_ACTIVE = f"""{_PERSONS}, cr AS (SELECT ts, event_id, floor(abs(value)) AS duration, person AS a, concat('U', k) AS b, concat('+91', k + 9000000000) AS bp FROM ev WHERE event_type <> 'purchase' AND event_id % 50 <> 0 AND event_id % 70 <> 0),
tr AS (SELECT ts, abs(value) AS amount, person AS a, concat('U', k) AS b FROM ev WHERE event_type = 'purchase' AND event_id % 40 <> 0 AND event_id % 45 <> 0 AND event_id % 60 <> 0),
cl AS (SELECT a AS person, CASE WHEN b IN (SELECT person FROM persons) THEN b ELSE bp END AS contact, ts, duration FROM cr UNION ALL SELECT b, a, ts, duration FROM cr WHERE b IN (SELECT person FROM persons)),
tl AS (SELECT a AS person, ts, amount FROM tr UNION ALL SELECT b, ts, amount FROM tr WHERE b IN (SELECT person FROM persons)),
n AS (SELECT greatest(1, count(DISTINCT CAST(ts AS DATE))) AS days FROM (SELECT ts FROM cl UNION ALL SELECT ts FROM tl UNION ALL SELECT CAST(day AS TIMESTAMP) FROM places)),
c AS (SELECT person, round(count(*) / (SELECT days FROM n), 2) AS calls_per_day, CAST(count(DISTINCT contact) AS DOUBLE) AS unique_contacts, round(CAST(sum(CAST(duration AS DECIMAL(18,4))) AS DOUBLE) / count(duration), 2) AS average_call_duration, CAST(count(*) FILTER (WHERE hour(ts) < 5) AS DOUBLE) AS night_calls FROM cl GROUP BY 1),
t AS (SELECT person, CAST(count(*) AS DOUBLE) AS transaction_count, round(CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE), 2) AS transaction_amount FROM tl GROUP BY 1)"""


def _people(spark, d):
    """Persons with their phone and account, as resolution leaves them."""
    k = F.substring("person", 2, 12).cast("bigint")
    return V.persons(spark, d).select(F.col("person").alias("id"), F.lit("").alias("created_at"), F.struct(F.array(F.concat(F.lit("+91"), (k + 9000000000).cast("string"))).alias("phones"), F.array(F.concat(F.lit("ACC"), "person")).alias("accounts")).alias("attributes"))


def _activity(spark, d):
    valid = {k: files.split_records(s)[0].select("normalized.*") for k, s in _standard(spark, d).items() if k in ("CDR", "TRANSACTION")}
    people = _people(spark, d)
    calls = features.call_legs(valid["CDR"].withColumnRenamed("timestamp", "ts"), features.first_owner(people, "phones"))
    paid = valid["TRANSACTION"].select(F.col("sender_account").alias("sender"), F.col("receiver_account").alias("receiver"), F.col("timestamp").alias("ts"), "amount")
    return calls, features.transfer_legs(paid, features.first_owner(people, "accounts"))


@query(f"{_ACTIVE} SELECT p.person, coalesce(calls_per_day, 0) AS calls_per_day, coalesce(unique_contacts, 0) AS unique_contacts, coalesce(average_call_duration, 0) AS average_call_duration, coalesce(night_calls, 0) AS night_calls, coalesce(transaction_count, 0) AS transaction_count, coalesce(transaction_amount, 0) AS transaction_amount FROM persons p LEFT JOIN c USING (person) LEFT JOIN t USING (person)".replace("{_ACTIVE}", _ACTIVE))
def activity_features(spark, d):
    """Features from record files: both sides of calls and transfers, through
    the phones and accounts of persons."""
    calls, paid = _activity(spark, d)
    places = V.legs(spark, d).filter("kind = 'place'")
    f = features.person_features(V.persons(spark, d), calls.unionByName(paid).unionByName(places))
    return f.drop("unique_locations", "location_changes")


@query(f"{_ACTIVE} SELECT person, contact, count(*) AS legs FROM cl GROUP BY 1, 2")
def activity_call_legs(spark, d):
    """Calls by person and contact: the other person, else the number."""
    return _activity(spark, d)[0].groupBy("person", "contact").agg(F.count("*").alias("legs"))


@query("SELECT DISTINCT concat('C', o_custkey) AS person, concat('P', l_partkey) AS location, CAST(o_orderdate AS DATE) AS day FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def report_observations(spark, d):
    """Persons at the places of the document that names both."""
    persons = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("person"), F.to_date("o_orderdate").alias("day"))
    places = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("location"))
    return features.place_legs(persons, places).select("person", "location", "day").distinct()


@query(
    f"""{_PARTS} SELECT doc_id, 'DATE' AS type, d AS raw, d AS value, 0.9::DOUBLE AS confidence FROM parts UNION ALL SELECT doc_id, 'PHONE', p, concat('+91', right(p, 10)), 0.97 FROM parts
UNION ALL SELECT doc_id, 'ACCOUNT', a, a, 0.97 FROM parts UNION ALL SELECT doc_id, 'VEHICLE', v, v, 0.97 FROM parts"""
)
def narrative_values(spark, d):
    return extract.extract_values(V.narratives(spark, d))


@query(f"{_PARTS} SELECT doc_id, 'LOCATION' AS type, l AS name FROM parts JOIN nation ON n_name = l")
def gazetteer_hits(spark, d):
    names = V.table(spark, d, "nation").select(F.lit("LOCATION").alias("type"), F.col("n_name").alias("name"))
    return extract.gazetteer_hits(V.narratives(spark, d), names)


_TEXT = "text AS (SELECT *, concat('On ', d, ' a caller on ', p, ' near ', l, ' paid from ', a, ' and left in ', v, '.') AS t FROM parts)"
_SPANS = " UNION ALL ".join(
    f"SELECT doc_id, 'temp_00{i}' AS span_id, '{kind}' AS type, {value} AS value, {normal} AS normalized_value, {c} AS raw, strpos(t, {c}) - 1 AS \"start\", strpos(t, {c}) - 1 + length({c}) AS \"end\", {conf}::DOUBLE AS confidence, '{method}' AS method, 'rules_only' AS nlp_backend FROM text"
    for i, (kind, c, value, normal, conf, method) in enumerate([("DATE", "d", "d", "d", 0.9, "regex_date"), ("PHONE", "p", "concat('+91', right(p, 10))", "concat('+91', right(p, 10))", 0.97, "regex_phone"), ("LOCATION", "l", "l", "lower(l)", 0.85, "gazetteer"), ("ACCOUNT", "a", "a", "a", 0.97, "regex_account"), ("VEHICLE", "v", "v", "v", 0.97, "regex_vehicle")], 1)
)


def _nations(spark, d):
    return [("LOCATION", r.n_name) for r in V.table(spark, d, "nation").select("n_name").collect()]  # 25 nations at every size


@query(f"{_PARTS}, {_TEXT} {_SPANS}")
def narrative_spans(spark, d):
    return extract.extract_spans(V.narratives(spark, d), _nations(spark, d))


_MADE = " UNION ALL ".join(f"SELECT doc_id, doc_id * 10 + {k} AS seq, '{kind}' AS type, {c} AS value FROM parts" for k, (kind, c) in enumerate([("DATE", "d"), ("PHONE", "concat('+91', right(p, 10))"), ("ACCOUNT", "a"), ("VEHICLE", "v")]))


@query(
    f"""{_PARTS}, m AS ({_MADE}), g AS (SELECT type, value, min(seq) AS first FROM m GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY first) AS n FROM g)
SELECT m.seq, concat(lower(type), '_', lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0')) AS canonical_id, CASE WHEN seq = first THEN 'new_entity' WHEN type = 'DATE' THEN 'exact_match' ELSE lower(type) || '_match' END AS resolution_method FROM m JOIN k USING (type, value)"""
)
def resolve_batch(spark, d):
    """The identifiers of all reports to numbered entities."""
    found = extract.extract_values(V.narratives(spark, d))
    place = F.create_map(*[F.lit(x) for kv in {"DATE": 0, "PHONE": 1, "ACCOUNT": 2, "VEHICLE": 3}.items() for x in kv])
    said = found.select(F.col("doc_id").cast("string").alias("document_id"), (F.col("doc_id") * 10 + place[F.col("type")]).cast("long").alias("seq"), "type", "value", F.col("value").alias("normalized_value"), "confidence", F.lit("regex").alias("method"))
    resolved, _ = resolve.resolve_mentions(said)
    return resolved.select("seq", "canonical_id", F.array_join("resolution_method", "+").alias("resolution_method"))


@query()
def resolve_people(spark, d):
    """Persons of orders, some misspelt, joined by likeness and a shared phone."""
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    name = F.concat(F.lit("Customer "), F.sha2(F.col("o_custkey").cast("string"), 256).substr(1, 12), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(""))
    people = o.select("o_orderkey", F.lit(0).alias("k"), F.lit("PERSON").alias("type"), name.alias("value"))
    phones = o.select("o_orderkey", F.lit(1).alias("k"), F.lit("PHONE").alias("type"), F.concat(F.lit("+91"), (F.col("o_custkey") + 9000000000).cast("string")).alias("value"))
    said = people.unionByName(phones).select(F.col("o_orderkey").cast("string").alias("document_id"), (F.col("o_orderkey") * 2 + F.col("k")).cast("long").alias("seq"), "type", "value", F.lower("value").alias("normalized_value"), F.lit(0.9).alias("confidence"), F.lit("made").alias("method"))
    resolved, _ = resolve.resolve_mentions(said)
    return resolved.select("seq", "type", "canonical_id", F.array_join("resolution_method", "+").alias("resolution_method"), "match_confidence")


@query(f"| , {_ITEMS}, g AS (SELECT 'PERSON' AS type, name FROM entities WHERE type IN ('PERSON', 'ORGANIZATION') UNION SELECT 'LOCATION', name FROM entities WHERE type = 'LOCATION' UNION SELECT 'PERSON', text FROM top JOIN entities ON id = entity_id WHERE type IN ('PERSON', 'ORGANIZATION')) SELECT type, name FROM g")
def gazetteer_build(spark, d):
    m = V.mentions(spark, d).select("entity_id", "text", "confidence", F.col("document_id").alias("id"))
    return extract.build_gazetteer(V.entities(spark, d), m)


@query("| SELECT greatest(1, count(DISTINCT CAST(ts AS DATE))) AS days FROM ev")
def window_days(spark, d):
    return V.table(spark, d, "events").agg(F.greatest(F.lit(1), F.count_distinct(F.to_date("ts"))).alias("days"))


@query("| SELECT person, count(*) AS legs, round(CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE), 2) AS total FROM (SELECT sender AS person, amount FROM transfers UNION ALL SELECT receiver, amount FROM transfers) GROUP BY 1")
def txn_legs(spark, d):
    t = V.transfers(spark, d).select(F.explode(F.array("sender", "receiver")).alias("person"), F.col("amount").cast("decimal(18,4)").alias("amount"))
    return t.groupBy("person").agg(F.count("*").alias("legs"), F.round(F.sum("amount").cast("double"), 2).alias("total"))


@query(_hops(3))
def neighborhood_d3(spark, d):
    return graph.neighborhood(V.edges(spark, d), "U1", 3)


def _recent(kind: str) -> str:
    return f"| SELECT src, dst, ts, source FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts DESC, source) AS k FROM edges WHERE type = '{kind}') WHERE k <= 10"


def _recent_edges(spark, d, kind):
    newest = Window.partitionBy("src").orderBy(F.col("ts").desc(), "source")
    return V.edges(spark, d).filter(F.col("type") == kind).withColumn("k", F.row_number().over(newest)).filter("k <= 10").select("src", "dst", "ts", "source")


@query(_recent("CALLED"))
def comm_edges(spark, d):
    """The ten latest calls of each person."""
    return _recent_edges(spark, d, "CALLED")


@query(_recent("TRANSFERRED_TO"))
def txn_edges(spark, d):
    """The ten latest transfers of each person."""
    return _recent_edges(spark, d, "TRANSFERRED_TO")


@query("| SELECT location, person, count(*) AS n, max(day) AS last_day FROM places GROUP BY 1, 2")
def at_location(spark, d):
    return V.places(spark, d).groupBy("location", "person").agg(F.count("*").alias("n"), F.max("day").alias("last_day"))


@query("| SELECT type, count(*) AS n, count(person) AS known FROM edges LEFT JOIN persons ON person = dst GROUP BY 1")
def edge_endpoint_check(spark, d):
    """Edges by type, and those whose far end is a known person."""
    known = V.edges(spark, d).join(V.persons(spark, d), F.col("dst") == F.col("person"), "left")
    return known.groupBy("type").agg(F.count("*").alias("n"), F.count("person").alias("known"))


@query(f"{_ADJ} SELECT id, (SELECT count(*) > 100 FROM nodes) AS truncated FROM nodes ORDER BY id LIMIT 100")
def snapshot_capped(spark, d):
    """The first 100 nodes by id, and whether there are more (the feature)."""
    nodes, _, truncated = graph.snapshot(_graph(spark, d)[0], _dated(spark, d), 100, 300)
    return nodes.select("id", F.lit(truncated[0]).alias("truncated"))


_SUBGRAPH = f"""{_DATED}, near AS (SELECT 'U1' AS id UNION SELECT dst FROM edges WHERE src = 'U1' UNION SELECT src FROM edges WHERE dst = 'U1')"""


@query(f"| , {_DATED} SELECT concat('rel_', substr(sha256(concat_ws('|', src, type, dst, source)), 1, 16)) AS edge_id, src, dst, type, t AS timestamp FROM dated WHERE (src = 'U1' OR dst = 'U1') AND type = 'TRANSFERRED_TO' ORDER BY edge_id LIMIT 1500")
def subgraph_edges(spark, d):
    """The transfers at U1, as a subgraph of depth 1 gives them."""
    nodes = _graph(spark, d)[0].withColumn("label", F.lit("Person"))
    return graph.subgraph(nodes, _dated(spark, d), "U1", 1, ["TRANSFERRED_TO"], None, 500, 1500)[1].select("edge_id", "src", "dst", "type", "timestamp")


@query(f"| , {_SUBGRAPH} SELECT id FROM near ORDER BY CASE WHEN id = 'U1' THEN 0 ELSE 1 END, id LIMIT 500")
def subgraph_nodes(spark, d):
    nodes = _graph(spark, d)[0].withColumn("label", F.lit("Person"))
    return graph.subgraph(nodes, _dated(spark, d), "U1", 1, None, None, 500, 1500)[0].select("id")


@query("| SELECT id, type, name FROM entities ORDER BY name, id LIMIT 100 OFFSET 100")
def directory_sorted(spark, d):
    """The second page of 100 of the directory by name (the feature)."""
    return V.entities(spark, d).orderBy("name", "id").offset(100).limit(100)


@query(f"{_FEATURES} SELECT person, " + ", ".join(f"round(CASE WHEN max({x}) OVER () > 0 THEN {x} / max({x}) OVER () ELSE 0 END, 6) AS {x}" for x in features.FEATURES) + " FROM f")
def feature_heat(spark, d):
    f = _features(spark, d)
    top = f.agg(*[F.max(x).alias(f"max_{x}") for x in features.FEATURES])
    heat = [F.round(F.when(F.col(f"max_{x}") > 0, F.col(x) / F.col(f"max_{x}")).otherwise(0.0), 6).alias(x) for x in features.FEATURES]
    return f.join(F.broadcast(top)).select("person", *heat)  # top is one row


@query("| SELECT (SELECT count(*) FROM persons) AS persons, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM edges) AS relationships, (SELECT count(*) FROM mentions) AS mentions")
def kpis(spark, d):
    counts = {"persons": V.persons(spark, d), "entities": V.entities(spark, d), "relationships": V.edges(spark, d), "mentions": V.mentions(spark, d)}
    kinds = None
    for name, frame in counts.items():
        one = frame.select(F.lit(name).alias("k"))
        kinds = one if kinds is None else kinds.unionByName(one)
    return kinds.agg(*[F.count_if(F.col("k") == name).alias(name) for name in counts])


@query("| SELECT CAST(d AS DATE) AS day, count(ts) AS n FROM (SELECT unnest(generate_series(CAST((SELECT max(ts) FROM ev) AS DATE) - 83, CAST((SELECT max(ts) FROM ev) AS DATE), INTERVAL 1 DAY)) AS d) LEFT JOIN ev ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY 1")
def weekly_activity(spark, d):
    """The last twelve weeks up to the last event, every day."""
    events = V.table(spark, d, "events")
    last = events.agg(F.to_date(F.max("ts"))).first()[0]
    return reads.weekly_grid(events, F.lit(last).cast("date"))


@query(f"| , {_NAMED}, k AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY 1) SELECT names.id, names.name, coalesce(k.n, 0) AS links, CASE WHEN k.n IS NULL THEN '—' ELSE printf('%.2f', k.n / 7.0 + 1e-9) END AS shown FROM names LEFT JOIN k ON k.id = names.id")
def scores_shown(spark, d):
    """Names with their links, and a score as a reader sees it."""
    k = V.edges(spark, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    both = reads.with_scores(_named(spark, d), k)
    return both.select("id", "name", F.coalesce("n", F.lit(0)).alias("links"), N.shown_score(F.col("n") / 7.0).alias("shown"))


@query("| SELECT id, type, label, value FROM (SELECT id, type, CASE type WHEN 'VEHICLE' THEN name WHEN 'LOCATION' THEN name ELSE coalesce(nullif(name, ''), id) END AS label, name AS value FROM entities)")
def node_view(spark, d):
    """Entities as a graph view shows them."""
    label = F.create_map(*[F.lit(x) for kv in {"PERSON": "Person", "ORGANIZATION": "Organization", "VEHICLE": "Vehicle", "LOCATION": "Location"}.items() for x in kv])
    e = V.entities(spark, d)
    null = F.lit(None).cast("string")
    car = F.col("type") == "VEHICLE"
    node = {"id": F.col("id"), "name": F.when(~car, F.col("name")), "registration_number": F.when(car, F.col("name")), "number": null, "account_number": null, "label": label[F.col("type")]}
    view = e.select("name", reads.cytoscape_node(node).alias("v"))
    return view.select("v.id", "v.type", "v.label", F.coalesce(F.col("v.metadata")["registration_number"], "name").alias("value"))


@query("| SELECT entity_id, document_id, text, confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, document_id) AS k FROM mentions) WHERE k <= 5")
def mentions_top(spark, d):
    """The five surest mentions of each entity."""
    best = Window.partitionBy("entity_id").orderBy(F.col("confidence").desc(), "document_id")
    return V.mentions(spark, d).withColumn("k", F.row_number().over(best)).filter("k <= 5").drop("k")


def _results(spark, d):
    """The surrogate anomaly as results: reason texts included."""
    f = _features(spark, d)
    an = features.surrogate_scores(f).join(features.with_reasons(f).select("person", "reasons"), "person")
    reason = F.when(F.size("reasons") > 0, F.array_join("reasons", "; ")).otherwise(reads.NO_SIGNAL)
    return an.select(F.col("person").alias("id"), F.col("person").alias("entity_id"), F.col("anomaly").alias("score"), N.severity(F.col("anomaly")).alias("severity"), reason.alias("reason"), F.lit("").alias("created_at"))


def _reports(spark, d):
    """Reports of all persons; a group is the number's remainder by five, and
    the persons' orders are their sources."""
    pr, bw = _measures(spark, d)
    people = V.persons(spark, d).select(F.col("person").alias("id"))
    scores = people.join(pr, "id", "left").join(bw, "id", "left").select("id", F.lit(0).alias("degree"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pagerank", "betweenness")], (F.substring("id", 2, 12).cast("bigint") % 5).alias("community"))
    entities = _named(spark, d).withColumn("type", F.lit("PERSON"))
    mentions = V.table(spark, d, "orders").select(F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("entity_id"), F.col("o_orderkey").alias("document_id"), ((F.col("o_orderkey") % 100) / 100).alias("confidence"))
    return reads.reports(entities, scores, _results(spark, d), _dated(spark, d), mentions)


_REPORT = f"""{_SCORES}, md AS (SELECT {", ".join(f"median({x}) AS {x}" for x in features.FEATURES)} FROM f),
rs AS (SELECT f.person, list_filter([
  CASE WHEN f.calls_per_day > 0 AND f.calls_per_day >= greatest(2.0, md.calls_per_day * 2) THEN 'Communication spike' END,
  CASE WHEN f.unique_contacts > 0 AND f.unique_contacts >= greatest(5.0, md.unique_contacts * 2) THEN 'High number of unique contacts' END,
  CASE WHEN f.night_calls > 0 AND f.night_calls >= greatest(3.0, md.night_calls * 2) THEN 'Unusual night-call activity' END,
  CASE WHEN f.transaction_amount > 0 AND f.transaction_amount >= greatest(100000.0, md.transaction_amount * 3) THEN 'Large transaction activity' END,
  CASE WHEN f.transaction_count > 0 AND f.transaction_count >= greatest(5.0, md.transaction_count * 2) THEN 'Unusual transaction frequency' END,
  CASE WHEN f.location_changes > 0 AND f.location_changes >= greatest(3.0, md.location_changes * 2) THEN 'Unusual location changes' END,
  CASE WHEN f.unique_locations > 0 AND f.unique_locations >= greatest(4.0, md.unique_locations * 2) THEN 'High location diversity' END], lambda x: x IS NOT NULL) AS said FROM f, md),
rel AS (SELECT id, count(*) AS edges FROM (SELECT DISTINCT src AS id, concat_ws('|', src, type, dst, source) AS e FROM edges UNION SELECT dst, concat_ws('|', src, type, dst, source) FROM edges) GROUP BY 1),
src AS (SELECT concat('U', o_custkey) AS id, count(*) AS n FROM orders GROUP BY 1),
rep AS (SELECT sc.person AS id, sc.priority, coalesce(sc.pr, 0) AS pr, coalesce(sc.bw, 0) AS bw, sc.an, said, CAST(substr(sc.person, 2) AS BIGINT) % 5 AS community, least(10, coalesce(rel.edges, 0)) AS relations, least(100, coalesce(rel.edges, 0)) AS events, least(100, coalesce(src.n, 0)) AS sources,
  list_concat(list_filter([CASE WHEN coalesce(sc.pr, 0) >= 0.7 THEN 'High structural importance in the network' END, CASE WHEN coalesce(sc.bw, 0) >= 0.7 THEN 'Acts as a bridge between network groups' END, CASE WHEN sc.an >= 0.7 THEN 'Unusual activity pattern' END], lambda x: x IS NOT NULL), list_transform(said, lambda x: concat('Anomaly evidence: ', x))) AS expl
  FROM sc JOIN rs ON rs.person = sc.person LEFT JOIN rel ON rel.id = sc.person LEFT JOIN src ON src.id = sc.person)"""


@query(
    f"""{_REPORT} SELECT id, concat('Person ', id) AS name, priority, pr AS pagerank, bw AS betweenness, an AS anomaly, community, CASE WHEN an >= 0.8 THEN 'HIGH' WHEN an >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
CASE WHEN len(said) = 0 THEN 'No anomaly signal' ELSE array_to_string(said, '; ') END AS anomaly_reasons, array_to_string(expl, '; ') AS explanations, relations, events, sources FROM rep"""
)
def investigation(spark, d):
    """The report of each person, lists shown by their size or as text."""
    many = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    return _reports(spark, d).select("id", "name", "priority", "pagerank", "betweenness", "anomaly", "community", "severity", F.array_join("anomaly_reasons", "; ").alias("anomaly_reasons"), F.array_join("explanations", "; ").alias("explanations"), many("key_relationships").alias("relations"), many("timeline").alias("events"), many("sources").alias("sources"))


_SAID = f"""{_REPORT}, w AS (SELECT *, CASE WHEN pr >= bw AND pr >= an THEN 'network influence' WHEN bw >= an THEN 'bridge role' ELSE 'unusual-pattern flag' END AS best, greatest(pr, bw, an) AS most, list_slice(list_concat(said, expl), 1, 3) AS signals FROM rep)"""


@query(
    f"""{_SAID} SELECT id, concat_ws(' ', concat('Person ', id, ' (', id, ') has ', CASE WHEN priority >= 0.6 THEN 'the highest' WHEN priority >= 0.35 THEN 'an elevated' ELSE 'a routine' END, ' review priority of ', printf('%.2f', priority + 1e-9), ' out of 1.'),
CASE WHEN most > 0 THEN concat('The biggest contributor is ', best, ' (', printf('%.2f', most + 1e-9), ').') END, CASE WHEN len(signals) > 0 THEN concat('Notable signals: ', array_to_string(signals, '; '), '.') END,
concat('On file: ', concat_ws(', ', CASE WHEN relations > 0 THEN concat(relations, CASE WHEN relations = 1 THEN ' key link' ELSE ' key links' END) END, CASE WHEN sources > 0 THEN concat(sources, CASE WHEN sources = 1 THEN ' source record' ELSE ' source records' END) END, concat('close-knit group ', community)), '.'),
'These are leads for investigator review, not findings of guilt.') AS narrative FROM w"""
)
def narrative(spark, d):
    """A few sentences on each person's report."""
    return reads.narratives(_reports(spark, d))


@query()
def narrative_hindi(spark, d):
    return reads.narratives(_reports(spark, d), "hi")
