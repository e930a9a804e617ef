"""Lookups, filters and small reports over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inquiro.functions import normalize as N
from inquiro.operators import extract, graph, reads
from inquiro.plans import views as V
from inquiro.plans.queries import query
from inquiro.plans.reads import _BAD
from inquiro.sources import files

_RATED = "rated AS (SELECT concat('C', c_custkey) AS id, c_nationkey AS community, abs(c_acctbal) / 10000 AS pagerank, count(o_orderkey) AS degree, (c_custkey % 97) / 97.0::DOUBLE AS betweenness FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"


def _rated(spark, d):
    """Customers as scored nodes: nation as community, orders as degree."""
    c = V.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("degree"))
    joined = c.join(n, "c_custkey", "left")
    return joined.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("community"), (F.abs("c_acctbal") / 10000).alias("pagerank"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), ((F.col("c_custkey") % 97) / F.lit(97.0)).alias("betweenness"))


@query(f"SELECT * FROM (WITH {_RATED} SELECT * FROM rated WHERE community = 7)")
def metrics_of_community(spark, d):
    return reads.metrics(_rated(spark, d), community=7)


@query(f"SELECT * FROM (WITH {_RATED} SELECT * FROM rated WHERE id = 'C7')")
def metrics_of_entity(spark, d):
    return reads.metrics(_rated(spark, d), entity_id="C7")


@query(f"SELECT * FROM (WITH {_RATED} SELECT community, count(*) AS size FROM rated GROUP BY community)")
def community_sizes(spark, d):
    return graph.community_sizes(_rated(spark, d))


_PRIORITY = "round(0.35 * least(1, pagerank) + 0.35 * betweenness + 0.30 * (degree % 7) / 7, 4)"


@query(f"SELECT * FROM (WITH {_RATED} SELECT id, {_PRIORITY} AS priority FROM rated ORDER BY priority DESC, id LIMIT 5)")
def top_priorities(spark, d):
    """The five first by priority (the feature)."""
    rows = _rated(spark, d).select("id", N.priority(F.col("pagerank"), F.col("betweenness"), (F.col("degree") % 7) / 7).alias("priority"))
    return reads.top_priorities(rows)


@query(
    f"""SELECT * FROM (WITH {_RATED}, five AS (SELECT id, {_PRIORITY} AS priority FROM rated ORDER BY priority DESC, id LIMIT 5), c AS (SELECT community, count(*) AS size FROM rated GROUP BY 1)
SELECT (SELECT count(*) FROM rated) AS nodes, (SELECT count(*) FROM c) AS communities, (SELECT max(size) FROM c) AS largest_community, (SELECT string_agg(id, ', ' ORDER BY priority DESC, id) FROM five) AS top_five)"""
)
def dashboard_kpis(spark, d):
    """Counts of nodes and communities, the largest one, the five first."""
    rows = _rated(spark, d)
    sizes = graph.community_sizes(rows).agg(F.count("*").alias("communities"), F.max("size").alias("largest_community"))
    five = reads.top_priorities(rows.select("id", N.priority(F.col("pagerank"), F.col("betweenness"), (F.col("degree") % 7) / 7).alias("priority")))
    first = five.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "id"))), lambda x: x.id), ", ").alias("top_five"))
    return rows.agg(F.count("*").alias("nodes")).crossJoin(sizes).crossJoin(first)  # a row each


@query("| SELECT * FROM entities WHERE id = 'S7'")
def entity_lookup(spark, d):
    return graph.get_entity(V.entities(spark, d), "S7")


@query("| SELECT id, type, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS rn FROM (SELECT 0 AS k, * FROM entities WHERE type = 'PERSON' AND substr(id, 2)::BIGINT % 2 = 0 UNION ALL SELECT 1, id, 'OTHER', name FROM entities WHERE type <> 'LOCATION')) WHERE rn = 1")
def entities_of_two_stores(spark, d):
    """The union of two stores, of each id the row of the first."""
    e = V.entities(spark, d)
    first = e.filter((F.col("type") == "PERSON") & (F.substring("id", 2, 20).cast("bigint") % 2 == 0))
    return reads.first_of_each([first, e.filter("type <> 'LOCATION'").withColumn("type", F.lit("OTHER"))], "id").select("id", "type", "name")


@query("| SELECT 'Entity' AS label, name AS id, count(*) AS n FROM entities GROUP BY name HAVING count(*) > 1")
def repeated_node_ids(spark, d):
    """Names that several entities have, as ids that are not unique."""
    return graph.repeated_ids(V.entities(spark, d).select(F.lit("Entity").alias("label"), F.col("name").alias("id")))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'USED' WHEN 'view' THEN 'CALLED' WHEN 'purchase' THEN 'TRANSFERRED_TO' END AS type FROM events")
def relation_types(spark, d):
    """Relationship types of raw names, aliases resolved; null if unknown."""
    raw = F.when(F.col("event_type") == "click", "USES").when(F.col("event_type") == "view", "CALLED").when(F.col("event_type") == "purchase", "TRANSFERRED_TO").otherwise("KNOWS")
    return V.table(spark, d, "events").select("event_id", graph.relation(raw).alias("type"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '0.5' END AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS timestamp, CASE WHEN o_orderkey % 5 = 0 THEN concat('R', o_custkey) ELSE concat('S', o_orderkey) END AS source_record FROM orders")
def edge_metadata(spark, d):
    """What an edge shows: confidence, time, and its record or else source."""
    k = F.col("o_orderkey")
    shown = reads.edge_metadata(F.when(k % 3 == 0, 0.5), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(k % 5 == 0, F.concat(F.lit("R"), F.col("o_custkey").cast("string"))), F.concat(F.lit("S"), k.cast("string")))
    return V.table(spark, d, "orders").select(k.alias("id"), shown.alias("m")).select("id", *[F.col("m")[x].alias(x) for x in ("confidence", "timestamp", "source_record")])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE concat('Ann ', o_custkey) END AS name FROM orders")
def person_names(spark, d):
    """Names without role words and marks; too short ones are none."""
    k, name = F.col("o_orderkey"), F.concat(F.lit("Ann "), F.col("o_custkey").cast("string"))
    raw = F.when(k % 4 == 0, F.concat(F.lit("Witness  "), name)).when(k % 4 == 1, F.concat(F.lit("\tSUSPECTS "), name, F.lit(" ,."))).when(k % 4 == 2, name).otherwise("accused x")
    return V.table(spark, d, "orders").select(k.alias("id"), N.clean_person(raw).alias("name"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN '—' ELSE concat(CAST(round(c_nationkey * 100 / 25) AS BIGINT), '%') END AS share, CASE WHEN c_custkey % 10 = 0 THEN '—' ELSE format('{:,}', c_custkey * 1000) END AS amount FROM customer")
def shown_numbers(spark, d):
    """Shares as whole percents, numbers with separators, a dash for none."""
    k = F.col("c_custkey")
    return V.table(spark, d, "customer").select(k.alias("id"), N.shown_percent(F.when(k % 10 != 0, F.col("c_nationkey") / 25)).alias("share"), N.shown_integer(F.when(k % 10 != 0, k * 1000)).alias("amount"))


@query(f"{_BAD} SELECT id, field, code FROM (SELECT *, split_part(id, '_', 2)::BIGINT AS n FROM bad WHERE dataset = 'CDR') ORDER BY n, field, code LIMIT 50")
def first_record_errors(spark, d):
    """The first fifty errors of the call records (the feature)."""
    records = V.call_records(spark, d).withColumn("record", F.substring("cdr_id", 5, 20).cast("long"))
    errors = files.split_records(files.standardize(records, "CDR"))[1]
    return files.first_errors(errors).select(F.col("original")["cdr_id"].alias("id"), "field", "code")


@query("SELECT o_orderkey AS id, (SELECT ceil(count(*) / 20.0)::BIGINT FROM orders) AS page, (SELECT ceil(count(*) / 20.0)::BIGINT FROM orders) AS pages FROM orders ORDER BY o_orderkey OFFSET (SELECT (ceil(count(*) / 20.0)::BIGINT - 1) * 20 FROM orders)")
def last_page(spark, d):
    """A page far beyond the end is the last one."""
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    page, pages = reads.clamped_page(10**9, o.count(), 20)
    rows, _ = reads.page_of(o, [F.col("id")], page, 20)
    return rows.select("id", F.lit(page).cast("long").alias("page"), F.lit(pages).cast("long").alias("pages"))


@query("SELECT 2::BIGINT AS page, 30::BIGINT AS page_size, count(*) AS total, ceil(count(*) / 30.0)::BIGINT AS total_pages FROM orders")
def page_totals(spark, d):
    _, totals = reads.page_of(V.table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 2, 30)
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in totals.items()])


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events QUALIFY n <= 999")
def mention_numbers(spark, d):
    """Entities numbered through an upload, by record and place in it."""
    e = V.table(spark, d, "events").select("event_id", F.col("user_id").alias("upload_id"), F.col("ts").alias("record"), F.col("event_id").alias("place"))
    return extract.renumbered(e).select("event_id", F.substring("id", 6, 9).cast("long").alias("n")).filter("n <= 999")


@query(f"SELECT * FROM (WITH {_RATED} SELECT id, pagerank, row_number() OVER (ORDER BY pagerank DESC, id) AS place FROM rated QUALIFY place <= 20)")
def directory_by_pagerank(spark, d):
    """The first page of the directory by PageRank (the feature)."""
    rows = _rated(spark, d).select("id", "pagerank").orderBy(*reads.directory_order("pagerank")).limit(20)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*reads.directory_order("pagerank"))))  # twenty rows


@query(
    """| , adj AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst), s AS (SELECT person AS start FROM persons),
h1 AS (SELECT DISTINCT start, b AS id FROM s JOIN adj ON a = start), h2 AS (SELECT DISTINCT h1.start, b AS id FROM h1 JOIN adj ON a = h1.id),
far AS (SELECT start, id FROM h2 WHERE id <> start EXCEPT SELECT start, id FROM h1)
SELECT start, 0 AS dist, 1::BIGINT AS n FROM s UNION ALL SELECT start, 1, count(*) FROM h1 GROUP BY 1 UNION ALL SELECT start, 2, count(*) FROM far GROUP BY 1"""
)
def neighborhood_sizes(spark, d):
    """How many nodes lie at each distance of every person, in one search."""
    return graph.neighborhood_sizes(V.edges(spark, d), V.persons(spark, d).select(F.col("person").alias("start")), 2)
