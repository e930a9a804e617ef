"""Adapter views: the given tables as calls, transfers, places, a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquiro.operators.features import LEG


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("person"), k.alias("k"))


def spread(rows: DataFrame) -> DataFrame:
    """A table may come in one file of few row groups; what is read from its
    texts is dealt over all tasks, while the rows are still narrow."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, caller, receiver, ts, duration)"""
    return _events(spark, sf_dir).filter("event_type <> 'purchase'").select(F.concat(F.lit("CDR_"), F.col("event_id").cast("string")).alias("call_id"), F.col("person").alias("caller"), F.concat(F.lit("K"), F.col("k").cast("string")).alias("receiver"), "ts", F.col("value").alias("duration"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, sender, receiver, ts, amount)"""
    return _events(spark, sf_dir).filter("event_type = 'purchase'").select(F.concat(F.lit("TXN_"), F.col("event_id").cast("string")).alias("source_id"), F.col("person").alias("sender"), F.concat(F.lit("K"), F.col("k").cast("string")).alias("receiver"), "ts", F.col("value").alias("amount"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person, day, location)"""
    return _events(spark, sf_dir).select("person", F.to_date("ts").alias("day"), F.concat(F.lit("L"), (F.col("k") % 10).cast("string")).alias("location"))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity legs of all events in one scan: both sides of a call or a
    transfer, and the place of the acting person."""
    k = F.col("k").cast("string")
    other, place = F.concat(F.lit("K"), k).alias("other"), F.concat(F.lit("L"), (F.col("k") % 10).cast("string")).alias("place")
    e = _events(spark, sf_dir).select("person", "ts", "event_type", "value", other, place)
    # sides by number, so that what they share is made once, before they part
    e = e.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("side"))
    side = F.col("side")
    kind = F.when(side == 2, "place").when(F.col("event_type") == "purchase", "transfer").otherwise("call")
    values = {
        "person": F.when(side == 1, F.col("other")).otherwise(F.col("person")), "kind": kind, "day": F.to_date("ts"), "hour": F.when(side < 2, F.hour("ts")),
        "contact": F.when(kind == "call", F.when(side == 0, F.col("other")).otherwise(F.col("person"))), "duration": F.when(kind == "call", F.col("value")), "amount": F.when(kind == "transfer", F.col("value")), "location": F.when(side == 2, F.col("place")),
    }
    types = dict(c.rsplit(" ", 1) for c in LEG.split(", "))
    return e.select(*[v.cast(types[c]).alias(c) for c, v in values.items()])


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("person").distinct()


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, name)"""
    parts = [("customer", "C", "c_custkey", "PERSON", "c_name"), ("supplier", "S", "s_suppkey", "ORGANIZATION", "s_name"), ("part", "P", "p_partkey", "VEHICLE", "p_name"), ("nation", "N", "n_nationkey", "LOCATION", "n_name")]
    frames = [table(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(n).alias("name")) for t, p, k, kind, n in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, document_id, text, confidence)"""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("entity_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("text"), ((F.col("o_orderkey") % 100) / 100).alias("confidence"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, type, ts, source): calls and transfers"""
    e, paid = _events(spark, sf_dir).filter("event_type is not null"), F.col("event_type") == "purchase"  # one scan
    source = F.concat(F.when(paid, "TXN_").otherwise("CDR_"), F.col("event_id").cast("string"))
    return e.select(F.col("person").alias("src"), F.concat(F.lit("K"), F.col("k").cast("string")).alias("dst"), F.when(paid, "TRANSFERRED_TO").otherwise("CALLED").alias("type"), "ts", source.alias("source"))


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a report for each order, with a date, a phone, a place,
    an account and a plate."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    phone = F.concat(F.when(k % 2 == 0, "+91").otherwise(""), (k + 9000000000).cast("string"))
    account = F.concat(F.lit("ACC"), F.lpad((c % 1000000).cast("string"), 6, "0"))
    plate = F.concat(F.lit("DL"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("AB"), F.lpad((k % 10000).cast("string"), 4, "0"))
    text = F.format_string("On %s a caller on %s near NATION_%d paid from %s and left in %s.", F.date_format("o_orderdate", "yyyy-MM-dd"), phone, c % 25, account, plate)
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")).select(k.alias("doc_id"), text.alias("text"))


def _number(x):
    return (x + 9000000000).cast("string")


def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw call records as a file holds them: every 50th caller is no phone,
    every 70th timestamp is missing."""
    e, i = spread(_events(spark, sf_dir).filter("event_type <> 'purchase'")), F.col("event_id")
    return e.select(
        F.concat(F.lit("CDR_"), i.cast("string")).alias("cdr_id"), F.when(i % 50 == 0, "12345").otherwise(_number(F.substring("person", 2, 12).cast("bigint"))).alias("caller"), _number(F.col("k")).alias("receiver"),
        F.when(i % 70 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), F.floor(F.abs("value")).cast("string").alias("duration"),
    )


def transfer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transfers: every 40th amount is negative, every 60th id is bad and
    every 45th currency is missing."""
    e, i = spread(_events(spark, sf_dir).filter("event_type = 'purchase'")), F.col("event_id")
    return e.select(
        F.concat(F.when(i % 60 == 0, "TXN #").otherwise("TXN_"), i.cast("string")).alias("transaction_id"), F.concat(F.lit("acc-"), "person").alias("sender_account"), F.concat(F.lit("acc U"), F.col("k").cast("string")).alias("receiver_account"),
        F.when(i % 40 == 0, "-1").otherwise(F.abs("value").cast("string")).alias("amount"), F.when(i % 45 == 0, " ").otherwise("inr").alias("currency"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )


def vehicle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw registrations: every 30th plate is no plate, every 35th owner is
    missing."""
    k = F.col("p_partkey")
    plate = F.concat(F.lit("dl-"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" ab "), F.lpad((k % 10000).cast("string"), 4, "0"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("V"), k.cast("string")).alias("vehicle_id"), F.when(k % 30 == 0, "DL1A1").otherwise(plate).alias("registration_number"), F.when(k % 35 != 0, F.concat(F.lit(" "), "p_brand")).alias("owner_name"))


def location_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw places: every 9th latitude is out of range, every 10th longitude no
    number, every 11th name missing."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("LOC_"), k.cast("string")).alias("location_id"), F.when(k % 11 != 0, F.concat(F.lit("Place  "), (k % 25).cast("string"))).alias("name"), F.when(k % 9 == 0, "90.5").otherwise((k % 90).cast("string")).alias("latitude"), F.when(k % 10 == 0, "east").otherwise((k % 180).cast("string")).alias("longitude"))


def report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reports: every 20th date is in another order, every 21st text blank."""
    n, k = narratives(spark, sf_dir), F.col("doc_id")
    day = F.substring("text", 4, 10)
    turned = F.concat(F.substring(day, 9, 2), F.lit("/"), F.substring(day, 6, 2), F.lit("/"), F.substring(day, 1, 4))
    return n.select(F.concat(F.lit("FIR_"), k.cast("string")).alias("fir_id"), F.when(k % 20 == 0, turned).otherwise(day).alias("date"), F.when(k % 21 == 0, "  ").otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("police_station"), F.lit("web").alias("source"))


RECORDS = {"FIR": report_records, "CDR": call_records, "TRANSACTION": transfer_records, "VEHICLE": vehicle_records, "LOCATION": location_records}


#: The same views in DuckDB's SQL, as a WITH list.
SQL = """
ev AS (SELECT event_id, ts, event_type, value, concat('U', user_id) AS person, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
calls AS (SELECT concat('CDR_', event_id) AS call_id, person AS caller, concat('K', k) AS receiver, ts, value AS duration FROM ev WHERE event_type <> 'purchase'),
transfers AS (SELECT concat('TXN_', event_id) AS source_id, person AS sender, concat('K', k) AS receiver, ts, value AS amount FROM ev WHERE event_type = 'purchase'),
places AS (SELECT person, CAST(ts AS DATE) AS day, concat('L', k % 10) AS location FROM ev),
persons AS (SELECT DISTINCT person FROM ev),
entities AS (SELECT concat('C', c_custkey) AS id, 'PERSON' AS type, c_name AS name FROM customer UNION ALL SELECT concat('S', s_suppkey), 'ORGANIZATION', s_name FROM supplier
  UNION ALL SELECT concat('P', p_partkey), 'VEHICLE', p_name FROM part UNION ALL SELECT concat('N', n_nationkey), 'LOCATION', n_name FROM nation),
mentions AS (SELECT concat('C', o_custkey) AS entity_id, o_orderkey AS document_id, o_orderpriority AS text, (o_orderkey % 100) / 100.0::DOUBLE AS confidence FROM orders),
edges AS (SELECT caller AS src, receiver AS dst, 'CALLED' AS type, ts, call_id AS source FROM calls UNION ALL SELECT sender, receiver, 'TRANSFERRED_TO', ts, source_id FROM transfers)
"""
