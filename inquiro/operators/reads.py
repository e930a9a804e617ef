"""Reads that serve an investigator: pages, filters, timelines, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inquiro.functions import normalize as N
from inquiro.operators import anomaly

# Entity types, event type of each relationship.
ENTITY_TYPES = ("PERSON", "PHONE", "LOCATION", "VEHICLE", "ORGANIZATION", "DATE", "ACCOUNT")
EVENT_TYPES = {"CALLED": "CALL", "MET": "MEETING", "TRANSFERRED_TO": "TRANSACTION", "LOCATED_AT": "LOCATION", "TRAVELLED_TO": "TRAVEL", "MENTIONED_IN": "FIR", "USED": "VEHICLE", "OWNS": "VEHICLE", "ASSOCIATED_WITH": "ASSOCIATION", "WORKS_FOR": "EMPLOYMENT"}
NO_SIGNAL = "No anomaly signal"


def page_of(rows: DataFrame, order: list[Column], page: int, size: int, most: int = 100) -> tuple[DataFrame, dict[str, int]]:
    """(the page's rows, {page, page_size, total, total_pages})."""
    if page < 1 or not 1 <= size <= most:
        raise ValueError("INVALID_PAGE")
    total = rows.count()
    return rows.orderBy(*order).offset((page - 1) * size).limit(size), {"page": page, "page_size": size, "total": total, "total_pages": -(-total // size)}


def clamped_page(page: int, total: int, size: int) -> tuple[int, int]:
    """(page, pages): at least one page, the page among them."""
    pages = max(1, -(-total // size))
    return min(max(1, page), pages), pages


def entity_items(entities: DataFrame, mentions: DataFrame, most: int = 100) -> DataFrame:
    """entities(id, type, name) with aliases (sorted mention texts that are
    not the name), source_refs and confidence, from the `most` surest mentions
    of each: a bounded list an entity."""
    best = Window.partitionBy("entity_id").orderBy(F.desc("confidence"), "document_id")
    top = mentions.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= most)
    said = top.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("text")).alias("texts"), F.transform(F.array_sort(F.collect_list(F.struct("k", "document_id"))), lambda x: x.document_id).alias("source_refs"), F.max("confidence").alias("confidence"))
    none = F.array().cast("array<string>")
    return entities.join(said, "id", "left").select("id", "type", "name", F.filter(F.coalesce("texts", none), lambda x: x != F.col("name")).alias("aliases"), "source_refs", "confidence")


def by_name(descending: bool = False) -> list[Column]:
    keys = [F.lower("name"), F.col("id")]
    return [k.desc() for k in keys] if descending else keys


def list_entities(items: DataFrame, *, kind: str | None = None, q: str | None = None) -> DataFrame:
    """Items of a type whose name or an alias holds q, in any case."""
    if kind is not None and kind not in ENTITY_TYPES:
        raise ValueError("INVALID_FILTER: type")
    out = items.filter(F.col("type") == kind) if kind else items
    return out.filter(F.lower("name").contains(q.lower()) | F.exists("aliases", lambda a: F.lower(a).contains(q.lower()))) if q else out


def search(items: DataFrame, q: str) -> DataFrame:
    """(id, type, name, match): where q was found first: name, id or alias."""
    q = q.strip().lower()
    if len(q) < 2 or any(ord(c) < 32 for c in q):
        raise ValueError("INVALID_QUERY")
    match = F.when(F.lower("name").contains(q), "name").when(F.lower("id").contains(q), "id").when(F.exists("aliases", lambda a: F.lower(a).contains(q)), "alias")
    return items.select("id", "type", "name", match.alias("match")).filter("match is not null")


def directory(items: DataFrame, *, q: str = "", kind: str | None = None) -> DataFrame:
    """Items with q in name, id and aliases read as one text."""
    out = items.filter(F.lower(F.concat_ws(" ", "name", "id", F.array_join("aliases", " "))).contains(q.strip().lower()))
    return out.filter(F.col("type") == kind) if kind else out


def with_scores(items: DataFrame, scores: DataFrame) -> DataFrame:
    """Items with the scores of their id, where there are some."""
    return items.join(scores, "id", "left")


def directory_order(by: str) -> list[Column]:
    """How the directory is sorted: by name, pagerank or priority."""
    if by == "name":
        return by_name()
    score = F.col("pagerank") if by == "pagerank" else F.coalesce("priority", "pagerank")
    return [F.coalesce(score, F.lit(-1.0)).desc(), F.col("id")]


def metrics(rows: DataFrame, *, entity_id: str | None = None, community: int | None = None) -> DataFrame:
    if entity_id is not None:
        return rows.filter(F.col("id") == entity_id)
    return rows.filter(F.col("community") == community) if community is not None else rows


def metric_order(metric: str) -> list[Column]:
    return [F.col(metric).desc(), F.col("id")] if metric in ("pagerank", "betweenness", "degree") else [F.col("id")]


def timeline(edges: DataFrame, names: DataFrame, *, start: str | None = None, end: str | None = None, types: set[str] | None = None) -> DataFrame:
    """(entity_id, timestamp, type, description, source_id, edge_id) of every
    entity: the edges at it that have a time and a source. edges has edge_id,
    src, dst, type, timestamp (ISO text) and source; names has id and name.
    Order by timestamp, edge_id."""
    if unknown := sorted(set(types or ()) - set(EVENT_TYPES.values())):
        raise ValueError(f"INVALID_FILTER: {unknown}")
    kind = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])[F.col("type")]
    dated = edges.withColumn("event", kind).filter("event is not null and timestamp is not null and source is not null")
    dated = dated.filter(F.col("timestamp") >= start) if start is not None else dated
    dated = dated.filter(F.col("timestamp") <= end) if end is not None else dated
    dated = dated.filter(F.col("event").isin(*types)) if types else dated
    sides = F.array(F.struct(F.col("src").alias("entity_id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("entity_id"), F.col("src").alias("other")))
    each = dated.select("edge_id", "timestamp", "event", "type", F.col("source").alias("source_id"), F.explode(F.when(F.col("src") == F.col("dst"), F.slice(sides, 1, 1)).otherwise(sides)).alias("s")).select("*", "s.entity_id", "s.other").drop("s")
    named = each.join(names.select(F.col("id").alias("entity_id"), F.col("name").alias("own")), "entity_id", "left").join(names.select(F.col("id").alias("other"), F.col("name").alias("far")), "other", "left")
    description = F.concat(F.coalesce("own", "entity_id"), F.lit(" —"), F.col("type"), F.lit("→ "), F.coalesce("far", "other"))
    return named.select("entity_id", "timestamp", F.col("event").alias("type"), description.alias("description"), "source_id", "edge_id")


def link_check(edges: DataFrame, members: list[str]) -> tuple[DataFrame, DataFrame]:
    """(direct edges between members, shared contacts with their owners, most
    owners first): for two to four ids."""
    if not 2 <= len(set(members)) <= 4:
        raise ValueError("INVALID_FILTER: two to four ids")
    inside = lambda c: F.col(c).isin(*members)
    direct = edges.filter(inside("src") & inside("dst") & (F.col("src") != F.col("dst"))).orderBy("edge_id")
    sides = F.array(F.struct(F.col("src").alias("owner"), F.col("dst").alias("contact")), F.struct(F.col("dst").alias("owner"), F.col("src").alias("contact")))
    met = edges.filter(inside("src") | inside("dst")).select(F.explode(sides).alias("s")).select("s.*").filter(inside("owner") & ~inside("contact")).distinct()
    shared = met.groupBy("contact").agg(F.array_sort(F.collect_set("owner")).alias("owners")).filter(F.size("owners") >= 2)  # four at most
    return direct, shared.orderBy(F.desc(F.size("owners")), "contact")


def priorities(scores: DataFrame, results: DataFrame) -> DataFrame:
    """(id, degree, pagerank, betweenness, community, anomaly, priority,
    priority_100, reasons): metrics(id, degree, pagerank, betweenness,
    community) and the latest anomaly results joined, zero where one lacks."""
    newest = anomaly.latest(results).select(F.col("entity_id").alias("id"), F.col("score").alias("anomaly"))
    both = scores.join(newest, "id", "full_outer")
    parts = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pagerank", "betweenness", "anomaly")]
    out = both.select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), *parts, "community")
    at = (F.col("pagerank"), F.col("betweenness"), F.col("anomaly"))
    return out.withColumns({"priority": N.priority(*at), "priority_100": N.priority_100(*at), "reasons": N.score_reasons(*at)})


def top_priorities(rows: DataFrame, n: int = 5) -> DataFrame:
    return rows.orderBy(F.desc("priority"), "id").limit(n)


def reports(entities: DataFrame, scores: DataFrame, results: DataFrame, edges: DataFrame, mentions: DataFrame, *, relations: int = 10, events: int = 100, sources: int = 100) -> DataFrame:
    """A report of each entity: priority and its parts, anomaly, explanations,
    first relationships, timeline and sources (bounded lists, by the given
    numbers)."""
    newest = anomaly.latest(results).select(F.col("entity_id").alias("id"), "severity", "reason")
    ranked = priorities(scores, results)
    said = F.when(F.coalesce("reason", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("reason", "; "))
    base = entities.select("id", "type", "name").join(ranked, "id", "left").join(newest, "id", "left").na.fill(0.0, ["pagerank", "betweenness", "anomaly", "priority"])
    notes = F.transform(F.filter(said, lambda r: (r != "") & (r != NO_SIGNAL)), lambda r: F.concat(F.lit("Anomaly evidence: "), r))
    none = F.array().cast("array<string>")
    base = base.select("id", "type", "name", "priority", "pagerank", "betweenness", "anomaly", "community", F.coalesce("severity", F.lit("LOW")).alias("severity"), said.alias("anomaly_reasons"), F.concat(F.coalesce("reasons", none), notes).alias("explanations"))

    def first(rows: DataFrame, key: str, order: list, n: int, item: Column, name: str) -> DataFrame:
        top = rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("k") <= n)
        return top.groupBy(F.col(key).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("v")))), lambda x: x.v).alias(name))

    touching = edges.select("edge_id", "src", "dst", "type", F.explode(F.array_distinct(F.array("src", "dst"))).alias("at"))
    parts = [
        first(touching, "at", ["edge_id"], relations, F.struct("edge_id", "src", "dst", "type"), "key_relationships"),
        first(timeline(edges, entities), "entity_id", ["timestamp", "edge_id"], events, F.struct("timestamp", "type", "description", "source_id"), "timeline"),
        first(mentions, "entity_id", [F.desc("confidence"), "document_id"], sources, F.col("document_id"), "sources"),
    ]
    return reduce(lambda a, b: a.join(b, "id", "left"), parts, base)


def narratives(rows: DataFrame, lang: str = "en") -> DataFrame:
    """(id, narrative) of reports(): sentences on score, largest part, signals
    and what is on file; what is unknown is left out."""
    hi = lang == "hi"
    # The sentences in English and Hindi.
    high, mid, low = ("सर्वोच्च समीक्षा प्राथमिकता", "बढ़ी हुई समीक्षा प्राथमिकता", "सामान्य समीक्षा प्राथमिकता") if hi else ("the highest review priority", "an elevated review priority", "a routine review priority")
    opening = "%s को 1 में से %s के साथ %s मिली है।" if hi else "%s has %s of %s out of 1."
    part_names = ("नेटवर्क प्रभाव", "सेतु भूमिका", "असामान्य पैटर्न चेतावनी") if hi else ("network influence", "bridge role", "unusual-pattern flag")
    largest_text = "सबसे बड़ा योगदान %s (%s) का है।" if hi else "The biggest contributor is %s (%s)."
    signals_text, filed_text = ("मुख्य संकेत: %s।", "फ़ाइल पर: %s।") if hi else ("Notable signals: %s.", "On file: %s.")
    links, records, group = ("%d मुख्य कड़ी", "%d स्रोत रिकॉर्ड", "घनिष्ठ समूह %d") if hi else ("%d key link", "%d source record", "close-knit group %d")
    closing = "ये जांचकर्ता समीक्षा के लिए संकेत हैं, दोष के निष्कर्ष नहीं।" if hi else "These are leads for investigator review, not findings of guilt."
    two = lambda c: F.format_string("%.2f", c)
    who = F.when(F.col("name").isNotNull() & (F.col("name") != F.col("id")), F.concat("name", F.lit(" ("), "id", F.lit(")"))).otherwise(F.col("id"))
    level = F.when(F.col("priority") >= 0.6, high).when(F.col("priority") >= 0.35, mid).otherwise(low)
    first = F.format_string(opening, who, two(F.col("priority")), level) if hi else F.format_string(opening, who, level, two(F.col("priority")))
    parts = F.array(*[F.struct(F.col(c).alias("x"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, (c, n) in enumerate(zip(("pagerank", "betweenness", "anomaly"), part_names))])
    best = F.array_max(parts)
    largest = F.when(best.x > 0, F.format_string(largest_text, best.n, two(best.x)))
    signals = F.slice(F.array_distinct(F.filter(F.concat("anomaly_reasons", "explanations"), lambda r: (r != "") & (r != NO_SIGNAL))), 1, 3)
    marked = F.when(F.size(signals) > 0, F.format_string(signals_text, F.array_join(signals, "; ")))
    count = lambda c: F.coalesce(F.size(c), F.lit(-1))
    plural = lambda c: F.when(F.lit(hi) | (count(c) == 1), "").otherwise("s")
    bits = F.array_compact(F.array(
        F.when(count("key_relationships") > 0, F.concat(F.format_string(links, count("key_relationships")), plural("key_relationships"))),
        F.when(count("sources") > 0, F.concat(F.format_string(records, count("sources")), plural("sources"))),
        F.when(F.col("community").isNotNull(), F.format_string(group, "community")),
    ))
    filed = F.when(F.size(bits) > 0, F.format_string(filed_text, F.array_join(bits, ", ")))
    return rows.select("id", F.concat_ws(" ", first, largest, marked, filed, F.lit(closing)).alias("narrative"))


def cytoscape_node(node: dict[str, Column]) -> Column:
    """id, label (the first of name, number, registration, account and id
    that is not empty), type and metadata of a node's properties."""
    label = F.coalesce(*[F.nullif(node[k], F.lit("")) for k in ("name", "number", "registration_number", "account_number", "id") if k in node])
    known = F.create_map(*[F.lit(x) for kv in {"Person": "PERSON", "Phone": "PHONE", "Location": "LOCATION", "Vehicle": "VEHICLE", "Organization": "ORGANIZATION", "BankAccount": "ACCOUNT", "FIR": "FIR"}.items() for x in kv])
    rest = F.create_map(*[x for k, v in node.items() if k not in ("id", "name", "label") for x in (F.lit(k), v.cast("string"))])
    return F.struct(node["id"].alias("id"), label.alias("label"), F.coalesce(known[node["label"]], F.lit("UNKNOWN")).alias("type"), F.map_filter(rest, lambda _, v: v.isNotNull()).alias("metadata"))


def edge_metadata(confidence: Column, timestamp: Column, source_record: Column, source_id: Column) -> Column:
    full = F.create_map(F.lit("confidence"), confidence.cast("string"), F.lit("timestamp"), timestamp, F.lit("source_record"), F.coalesce(source_record, source_id))
    return F.map_filter(full, lambda _, v: v.isNotNull())


def weekly_grid(moments: DataFrame, today: Column, weeks: int = 12) -> DataFrame:
    """(day, n) of the last `weeks` weeks up to today, every day, zero where
    nothing happened. moments has ts; today is a date."""
    span = weeks * 7
    days = moments.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, span - 1), today)).alias("day"))
    counts = moments.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def count_by_type(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("type", F.lit("UNKNOWN")).alias("type")).agg(F.count("*").alias("n"))


def first_of_each(frames: list[DataFrame], key: str) -> DataFrame:
    """The union of the frames, of each key the row of the first frame."""
    tagged = [f.withColumn("_k", F.lit(k)) for k, f in enumerate(frames)]
    both = reduce(DataFrame.unionByName, tagged)
    names = [c for c in frames[0].columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*names), F.struct("_k", *names)).alias("_r")).select(key, "_r.*").select(*frames[0].columns)
