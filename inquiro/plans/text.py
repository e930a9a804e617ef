"""Names in reports, listed and unlisted, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquiro.operators import extract
from inquiro.plans import views as V
from inquiro.plans.queries import query

_FIRST = ["Ka", "Ri", "Mo", "De", "Su", "An", "Vi", "Pa", "Lo", "Ze", "Ha", "Ju", "Ta"]
_LAST = ["ran", "mil", "vek", "dos", "lin", "tar", "nesh", "pur", "gop", "sai", "bir"]
_TRADES = ["Traders", "Motors", "Bank", "Mills"]


def _pick(words: list[str], k):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))


def _person(c):
    """A name made from a number."""
    return F.concat(_pick(_FIRST, c), _pick(_LAST, F.floor(c / 13)), F.lit(" "), _pick(_FIRST, F.floor(c / 143)), _pick(_LAST, F.floor(c / 7)))


def _firm(c):
    return F.concat(_pick(_FIRST, F.floor(c / 5)), _pick(_LAST, F.floor(c / 3)), F.lit(" "), _pick(_TRADES, c))


def named_reports(spark, d) -> DataFrame:
    """(doc_id, text, c): a report for each order, with a person, a firm and a
    place, in one of three forms."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    forms = ["Witness %s met a man of %s near NATION_%d.", "The accused %s paid %s in NATION_%d on Monday.", "Nobody saw %s. A van of %s left for NATION_%d."]
    text = F.when(k % 3 == 0, F.format_string(forms[0], _person(c), _firm(c), c % 25)).when(k % 3 == 1, F.format_string(forms[1], _person(c), _firm(c), c % 25)).otherwise(F.format_string(forms[2], _person(c), _firm(c), c % 25))
    return V.spread(V.table(spark, d, "orders").select("o_orderkey", "o_custkey")).select(k.alias("doc_id"), text.alias("text"), c.alias("c"))


def _customers(spark, d) -> DataFrame:
    return V.table(spark, d, "orders").select(F.col("o_custkey").alias("c")).distinct()


def _places(spark, d) -> DataFrame:
    return V.table(spark, d, "nation").select(F.lit("LOCATION").alias("type"), F.col("n_name").alias("name"))


def _at(words, k):
    return f"{words}[1 + CAST({k} AS BIGINT) % {len(words)}]"


_PERSON_SQL = f"concat({_at(_FIRST, 'c')}, {_at(_LAST, 'c // 13')}, ' ', {_at(_FIRST, 'c // 143')}, {_at(_LAST, 'c // 7')})"
_FIRM_SQL = f"concat({_at(_FIRST, 'c // 5')}, {_at(_LAST, 'c // 3')}, ' ', {_at(_TRADES, 'c')})"
_REPORTS_SQL = f"""WITH o AS (SELECT o_orderkey AS doc_id, o_custkey AS c FROM orders), n AS (SELECT *, {_PERSON_SQL} AS p, {_FIRM_SQL} AS f, concat('NATION_', c % 25) AS l FROM o),
t AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN concat('Witness ', p, ' met a man of ', f, ' near ', l, '.') WHEN 1 THEN concat('The accused ', p, ' paid ', f, ' in ', l, ' on Monday.') ELSE concat('Nobody saw ', p, '. A van of ', f, ' left for ', l, '.') END AS text FROM n)"""


def _spans_sql(k: int, kind: str, c: str, confidence: float) -> str:
    return f"SELECT doc_id, 'temp_00{k}' AS span_id, '{kind}' AS type, {c} AS value, lower({c}) AS normalized_value, {c} AS raw, strpos(text, {c}) - 1 AS \"start\", strpos(text, {c}) - 1 + length({c}) AS \"end\", {confidence}::DOUBLE AS confidence, 'gazetteer' AS method, 'rules_only' AS nlp_backend FROM t"


@query(f"SELECT * FROM ({_REPORTS_SQL} {_spans_sql(1, 'PERSON', 'p', 0.87)} UNION ALL {_spans_sql(2, 'PERSON', 'f', 0.87)} UNION ALL {_spans_sql(3, 'LOCATION', 'l', 0.85)})")
def gazetteer_spans(spark, d):
    """Spans of all customers', firms' and nations' names in the reports."""
    people = _customers(spark, d)
    names = people.select(F.lit("PERSON").alias("type"), _person(F.col("c")).alias("name")).unionByName(people.select(F.lit("PERSON").alias("type"), _firm(F.col("c")).alias("name"))).unionByName(_places(spark, d))
    return extract.extract_spans(named_reports(spark, d), names)


@query()
def narrative_names(spark, d):
    """Persons, firms and places by a tagger that has learnt from the reports
    of listed customers, two of three; the others' names are in no list."""
    docs = named_reports(spark, d)
    listed = _customers(spark, d).filter("c % 3 <> 0")
    names = listed.select(F.lit("PERSON").alias("type"), _person(F.col("c")).alias("name")).unionByName(listed.select(F.lit("ORGANIZATION").alias("type"), _firm(F.col("c")).alias("name"))).unionByName(_places(spark, d))
    weights = extract.learn_names(docs.filter("c % 3 <> 0"), names)
    return extract.extract_spans(docs, _places(spark, d), weights=weights)
