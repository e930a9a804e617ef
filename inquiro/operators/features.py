"""Activity legs, behavioural features of a person and how they stand out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inquiro.functions import normalize as N
from inquiro.operators.numbering import cumulative_below
from inquiro.storage import materialize

FEATURES = ("calls_per_day", "unique_contacts", "average_call_duration", "night_calls", "transaction_count", "transaction_amount", "unique_locations", "location_changes")
#: One row for each side of an event that a person takes part in.
LEG = "person string, kind string, day date, hour int, contact string, duration decimal(18,4), amount decimal(18,4), location string"


def first_owner(people: DataFrame, family: str) -> DataFrame:
    """(value, person): who has each identifier; of several persons the first
    by (created_at, id). people has id, created_at and attributes."""
    each = people.select("id", "created_at", F.explode(F.col("attributes")[family]).alias("value"))
    return each.groupBy("value").agg(F.min_by("id", F.struct("created_at", "id")).alias("person"))


def leg(person: Column, kind: str, ts: Column, *, contact: Column | None = None, duration: Column | None = None, amount: Column | None = None, location: Column | None = None) -> Column:
    """A leg as a struct; ts is a timestamp, a date or ISO text."""
    moment = ts.cast("string")
    values = {"person": person, "kind": F.lit(kind), "day": F.substring(moment, 1, 10).try_cast("date"), "hour": F.substring(moment, 12, 2).try_cast("int"), "contact": contact, "duration": duration, "amount": amount, "location": location}
    types = dict(c.rsplit(" ", 1) for c in LEG.split(", "))
    return F.struct(*[(F.lit(None) if v is None else v).cast(types[k]).alias(k) for k, v in values.items()])


def call_legs(calls: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Legs of calls(caller, receiver, ts, duration): one for each side that
    owners(value, person) knows, with the other side's person, or else its
    number, as contact. Without owners both sides are persons themselves."""
    if owners is None:
        both = calls.select("*", F.col("caller").alias("a"), F.col("receiver").alias("b"))
    else:
        both = calls.join(owners.select(F.col("value").alias("caller"), F.col("person").alias("a")), "caller", "left").join(owners.select(F.col("value").alias("receiver"), F.col("person").alias("b")), "receiver", "left")
    sides = [leg(F.col(x), "call", F.col("ts"), contact=F.coalesce(y, other), duration=F.col("duration")) for x, y, other in (("a", F.col("b"), F.col("receiver")), ("b", F.col("a"), F.col("caller")))]
    return both.select(F.explode(F.array(*sides)).alias("l")).select("l.*").filter("person is not null")


def transfer_legs(transfers: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Legs of transfers(sender, receiver, ts, amount), one a known side; two
    where a person pays themselves."""
    each = transfers.select(F.explode(F.array("sender", "receiver")).alias("account"), "ts", "amount")
    if owners is not None:
        each = each.join(owners.withColumnRenamed("value", "account"), "account").drop("account").withColumnRenamed("person", "account")
    return each.select(leg(F.col("account"), "transfer", F.col("ts"), amount=F.col("amount")).alias("l")).select("l.*")


def place_legs(persons: DataFrame, places: DataFrame) -> DataFrame:
    """Legs of each document's distinct persons(doc_id, person, day) at each
    of its places(doc_id, location)."""
    both = persons.select("doc_id", "person", "day").distinct().join(places.select("doc_id", "location"), "doc_id")
    return both.select(leg(F.col("person"), "place", F.col("day"), location=F.col("location")).alias("l")).select("l.*")


def person_features(persons: DataFrame, legs: DataFrame) -> DataFrame:
    """The eight features of every person; zero where nothing is known.

    One aggregate by person gives all but the changes of place, which need
    each person's distinct (day, place) in order. The window is the number of
    distinct days with a leg of these persons, a one-row aggregate.
    """
    known = materialize(legs.join(persons.select("person"), "person", "left_semi"))  # three readers, a few columns each
    days = known.agg(F.greatest(F.lit(1), F.count_distinct("day")).alias("days"))
    call = F.col("kind") == "call"
    sums = known.groupBy("person").agg(
        F.count_if(call).alias("calls"),
        F.count_distinct(F.when(call & (F.col("contact") != ""), F.col("contact"))).cast("double").alias("unique_contacts"),
        F.round(F.sum(F.when(call, F.col("duration"))).cast("double") / F.count(F.when(call, F.col("duration"))), 2).alias("average_call_duration"),
        F.count_if(call & (F.col("hour") < 5)).cast("double").alias("night_calls"),
        F.count_if(F.col("kind") == "transfer").cast("double").alias("transaction_count"),
        F.round(F.sum("amount").cast("double"), 2).alias("transaction_amount"),
    )
    seen = known.filter((F.col("kind") == "place") & (F.col("location") != "")).select("person", "day", "location").distinct()
    moved = seen.withColumn("before", F.lag("location").over(Window.partitionBy("person").orderBy("day", "location")))
    at = moved.groupBy("person").agg(F.count_distinct("location").cast("double").alias("unique_locations"), F.count_if(F.col("before") != F.col("location")).cast("double").alias("location_changes"))
    rates = sums.join(F.broadcast(days)).withColumn("calls_per_day", F.round(F.col("calls") / F.col("days"), 2))  # days is one row
    out = persons.select("person").join(rates, "person", "left").join(at, "person", "left")
    return out.select("person", *FEATURES).na.fill(0.0, list(FEATURES))


def _long(features: DataFrame) -> DataFrame:
    return features.select("person", F.expr("stack(8, " + ", ".join(f"'{f}', {f}" for f in FEATURES) + ") as (feature, x)"))


def medians(features: DataFrame) -> DataFrame:
    """One row: the exact median of each feature, 0 without rows. Values are
    counted, summed in ranges and the middle one or two picked."""
    values = _long(features).groupBy("feature", "x").agg(F.count("*").alias("n"))
    placed = cumulative_below(values, "x", "n", "feature")
    whole = placed.groupBy("feature").agg(F.sum("n").alias("all"))
    middle = placed.join(F.broadcast(whole), "feature")  # eight rows
    low, high = F.expr("(all - 1) div 2"), F.expr("all div 2")
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    each = middle.groupBy("feature").agg(((F.max(F.when(holds(low), F.col("x"))) + F.max(F.when(holds(high), F.col("x")))) / 2).alias("m"))
    return each.agg(*[F.coalesce(F.max(F.when(F.col("feature") == f, F.col("m"))), F.lit(0.0)).alias(f) for f in FEATURES])


def with_reasons(features: DataFrame) -> DataFrame:
    """features and `reasons`: one-row medians meet every row."""
    features = materialize(features)
    m = medians(features).toDF(*[f"m_{f}" for f in FEATURES])
    both = features.join(F.broadcast(m))  # one row
    return both.select(*features.columns, N.reasons({f: F.col(f) for f in FEATURES}, {f: F.col(f"m_{f}") for f in FEATURES}).alias("reasons"))


def surrogate_scores(features: DataFrame) -> DataFrame:
    """(person, anomaly): mean share of the persons below each feature, a
    score that plain SQL can state. Each feature's values are counted and
    summed in ranges, so no feature is ranked as one column of all rows."""
    features = materialize(features)
    long = _long(features)
    values = long.groupBy("feature", "x").agg(F.count("*").alias("n"))
    below = cumulative_below(values, "x", "n", "feature").select("feature", "x", "below")
    n = features.agg(F.greatest(F.lit(1), F.count("*") - 1).cast("double").alias("others"))
    joined = long.join(below, ["feature", "x"]).join(F.broadcast(n))  # one row
    return joined.groupBy("person").agg(F.round(F.sum(F.col("below") / F.col("others")) / len(FEATURES), 6).alias("anomaly"))
