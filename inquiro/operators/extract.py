"""Entities in narratives: patterns, gazetteer, overlap resolution."""

from __future__ import annotations

import bisect
import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inquiro.functions import normalize as N
from inquiro.operators import names as names_
from inquiro.operators import tagger
from inquiro.operators.numbering import numbered

# Method, type, pattern, confidence.
PATTERNS = [
    ("regex_phone", "PHONE", r"\+91[\s\-]?\(?\d{5}\)?[\s\-]?\d{5}", 0.97),
    ("regex_phone", "PHONE", r"(?<![\d+])(?:91[\s\-]?)?[6-9]\d{4}[\s\-]?\d{5}(?!\d)", 0.97),
    ("regex_vehicle", "VEHICLE", r"(?i)\b[A-Z]{2}[\s\-]?\d{1,2}[\s\-]?[A-Z]{1,3}[\s\-]?\d{4}\b", 0.97),
    ("regex_account", "ACCOUNT", r"(?i)\bACC[\s\-]?\d{3,6}\b", 0.97),
    ("regex_date", "DATE", r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:Z)?)?\b", 0.90),
]
_DIGITS = re.compile(r"\d{3}")  # every pattern asks for as many in a row
# Confidence of names; priority of methods, the lower wins.
GAZETTEER_CONFIDENCE = {"PERSON": 0.87, "LOCATION": 0.85}
REGEX_PRIORITY, GAZETTEER_PRIORITY, NER_PRIORITY = 1, 2, 3
MAX_NAME, BACKEND, TAGGER_BACKEND = 256, "rules_only", "ner+rules"
_NORMAL = {"PHONE": N.phone, "VEHICLE": N.vehicle, "ACCOUNT": N.account, "DATE": N.date}
_TOKEN = r"[^\p{L}\p{N}_]+"
SPANS = "span_id string, type string, value string, normalized_value string, raw string, start long, end long, confidence double, method string, nlp_backend string"


def extract_values(docs: DataFrame) -> DataFrame:
    """(doc_id, type, raw, value, confidence): every pattern match whose
    normal form exists, by built-in expressions in one pass over the texts.
    Normal forms are made with the matches, before these become rows: a filter
    on them, here or by a reader, then reads them and does not make them anew."""

    def hits(kind: str, pattern: str, confidence: float) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda raw: F.struct(F.lit(kind).alias("type"), raw.alias("raw"), _NORMAL[kind](raw).alias("value"), F.lit(confidence).alias("confidence")))

    found = [hits(kind, p, c) for _, kind, p, c in PATTERNS]
    # outer: else Spark makes all matches once more, to leave out the texts without any
    return docs.select("doc_id", F.explode_outer(F.concat(*found)).alias("e")).select("doc_id", "e.*").filter(F.col("value").isNotNull())


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), _TOKEN), lambda x: x != "")


def gazetteer_hits(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, type, name): names(type, name) in a text, case-insensitive at
    word bounds, any white space between a name's parts.

    The word sequences of a text, of each length that names have, meet the
    names' by an equi-join; the text itself then decides, so marks between
    words must agree. Names over 256 characters are left out.
    """
    listed = names.filter(F.length("name") <= MAX_NAME).select("type", "name").distinct().withColumn("w", _tokens(F.col("name"))).filter(F.size("w") > 0)
    lengths = sorted(r[0] for r in listed.select(F.size("w")).distinct().collect())  # at most 128 numbers
    parts = F.transform(F.filter(F.split("name", r"(?U)\s+"), lambda x: x != ""), lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), F.array_join(parts, r"(?U:\s+)"), F.lit(r"(?![\p{L}\p{N}_])"))
    keyed = listed.select("type", "name", F.array_join("w", " ").alias("gram"), pattern.alias("pattern"))

    def grams(n: int) -> Column:
        places = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice("w", i, n), " "))

    if not lengths:
        return docs.select("doc_id").limit(0).crossJoin(names.select("type", "name").limit(0))
    each = docs.select("doc_id", "text", _tokens(F.col("text")).alias("w")).select("doc_id", "text", F.explode(F.array_distinct(F.concat(*[grams(n) for n in lengths]))).alias("gram"))
    return each.join(keyed, "gram").filter(F.regexp_like("text", F.col("pattern"))).select("doc_id", "type", "name").distinct()


def build_gazetteer(entities: DataFrame, mentions: DataFrame, most: int = 100) -> DataFrame:
    """(type, name): the canonical names of entities(id, type, name) that are
    persons, organizations or places, and up to `most` mention texts of each
    (the surest). Organizations are listed as persons, as names share a list."""
    kind = F.when(F.col("type").isin("PERSON", "ORGANIZATION"), "PERSON").when(F.col("type") == "LOCATION", "LOCATION")
    known = entities.select("id", "name", kind.alias("type")).filter(F.col("type").isNotNull())
    best = Window.partitionBy("entity_id").orderBy(F.desc("confidence"), "id")
    said = mentions.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= most).select(F.col("entity_id"), "text")
    texts = known.join(said, F.col("id") == F.col("entity_id")).select("type", F.col("text").alias("name"))
    return known.select("type", "name").unionByName(texts).distinct()


def _date(raw: str) -> str | None:
    try:
        return dt.datetime.fromisoformat(raw.removesuffix("Z")).strftime("%Y-%m-%d")
    except ValueError:
        return None


def _checked(kind: str, raw: str) -> str | None:
    """The normal form of a pattern's match, or None if it has none."""
    if kind == "DATE":
        return _date(raw)
    bare = re.sub(r"[\s\-().]" if kind == "PHONE" else r"[\s\-]", "", raw).upper()
    if kind == "PHONE":
        m = re.fullmatch(r"\+?(?:91)?(\d{10})", bare, re.ASCII)
        return "+91" + m[1] if m else None
    return bare if kind == "ACCOUNT" or re.fullmatch(r"[A-Z]{2}\d{2}[A-Z]{2}\d{4}", bare) else None


def _person(raw: str) -> str | None:
    name = re.sub(N.ROLE_WORDS, "", raw.strip(), flags=re.I).strip(" ,.")
    return name if 2 <= len(name) <= MAX_NAME else None


# Type to the label that a method names, and its confidence.
NER = {"PERSON": ("person", 0.90), "ORGANIZATION": ("org", 0.85), "LOCATION": ("gpe", 0.85)}


class SpanFinder:
    """The spans of a text after overlap resolution."""

    def __init__(self, find_names: names_.Names | None = None, weights: tagger.Weights | None = None):
        self.patterns = [(m, k, re.compile(p), c) for m, k, p, c in PATTERNS]
        self.find_names, self.weights = find_names, weights
        self.backend = BACKEND if weights is None else TAGGER_BACKEND

    def __call__(self, text: str, hits: list[tuple[int, str, int, int]] | None = None, seen: list[tuple[str, int, int]] | None = None) -> list[tuple]:
        """hits: (number, kind, start, end) of listed names, seen: (kind, start,
        end) of the tagger's, if they are known."""
        found = []
        for method, kind, pattern, confidence in self.patterns if _DIGITS.search(text) else ():
            for m in pattern.finditer(text):
                value = _checked(kind, m[0])
                if value is not None:
                    found.append((REGEX_PRIORITY, m.start(), m.end(), kind, value, value, m[0], confidence, method))
        if hits is None:
            hits = self.find_names(text) if self.find_names else []
        for _, kind, start, end in hits:
            found.append(self.named(GAZETTEER_PRIORITY, kind, text[start:end], start, end, GAZETTEER_CONFIDENCE[kind], "gazetteer"))
        if self.weights is not None:
            for kind, start, end in tagger.spans_of(text, self.weights) if seen is None else seen:
                if end - start <= MAX_NAME:
                    label, confidence = NER[kind]
                    found.append(self.named(NER_PRIORITY, kind, text[start:end], start, end, confidence, f"ner_{label}"))
        starts: list[int] = []
        taken: list[tuple] = []  # disjoint, in order of place
        for s in sorted(filter(None, found), key=lambda s: (s[0], s[1] - s[2])):
            at = bisect.bisect(starts, s[1])
            if (at == 0 or taken[at - 1][2] <= s[1]) and (at == len(taken) or taken[at][1] >= s[2]):
                starts.insert(at, s[1])
                taken.insert(at, s)
        return taken

    @staticmethod
    def named(priority: int, kind: str, raw: str, start: int, end: int, confidence: float, method: str) -> tuple | None:
        value = _person(raw) if kind == "PERSON" else raw.strip()
        return (priority, start, end, kind, value, " ".join(value.split()).lower(), raw, confidence, method) if value else None


def extract_spans(docs: DataFrame, names: DataFrame | list[tuple[str, str]] = (), cap: int | None = None, weights: tagger.Weights | None = None, *, shard_bytes: int = names_.SHARD_BYTES) -> DataFrame:
    """The entities of each text of docs(doc_id, text): of overlapping spans
    the method of lower priority, then the longer span, then the pattern or
    name listed first wins; numbered in order of place. A match without a
    normal form is none. Whole texts are read unless a cap on their characters
    is given.

    names: (PERSON or LOCATION, name), as a list or as a table(type, name), of
    which the order is by hash. Up to shard_bytes of names go to every task;
    more are met in shards (names.find_names) and come back as the hits of each
    text. weights: of a trained tagger, which adds names that no list has.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text" if cap is None else F.substring("text", 1, cap).alias("text"))
    if not isinstance(names, DataFrame):
        numbers = {pair: k for k, pair in reversed(list(enumerate(names)))}
        known, small = [(k, *pair) for pair, k in numbers.items()], sum(len(n.encode()) for _, n in names) <= shard_bytes
        table = None if small else spark.createDataFrame(list(names), "type string, name string")
    else:
        small, table = names_.bytes_of(names) <= shard_bytes, names
        known = sorted(tuple(r) for r in names_.listed(names).collect()) if small else []
    sent = sc.broadcast((known, weights and (weights.of, weights.step)))
    hits = F.lit(None).cast("array<struct<number:long,kind:string,start:long,end:long>>")
    if small:
        rows = rows.withColumn("hits", hits)
    else:
        key = F.sha2(F.concat_ws("\u0001", F.coalesce(F.col("doc_id").cast("string"), F.lit("\u0002")), F.col("text")), 256)
        keyed = rows.withColumn("row", key)
        found = names_.find_names(keyed.select("row", "text").filter("text <> ''").distinct(), table, shard_bytes=shard_bytes)
        each = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("number", "kind", "start", "end"))).alias("hits"))
        rows = keyed.join(each, "row", "left").select("doc_id", "text", F.coalesce("hits", F.array().cast("array<struct<number:long,kind:string,start:long,end:long>>")).alias("hits"))

    def run(frames):
        listed, arrays = sent.value
        find = SpanFinder(names_.Names(listed) if small else None, arrays and tagger.Weights(*arrays))
        for pdf in frames:
            texts = [text or "" for text in pdf.text]
            seen = tagger.spans_of_texts(texts, find.weights) if find.weights else [None] * len(texts)
            made = [
                (doc, f"temp_{i:03d}", s[3], s[4], s[5], s[6], s[1], s[2], s[7], s[8], find.backend)
                for doc, text, hit, own in zip(pdf.doc_id, texts, pdf.hits, seen)
                for i, s in enumerate(find(text, None if small else [(h["number"], h["kind"], h["start"], h["end"]) for h in hit], own), 1)
            ]
            out = pd.DataFrame(made, columns=["doc_id", *(c.split()[0] for c in SPANS.split(", "))])
            out["doc_id"] = out["doc_id"].astype(pdf.doc_id.dtype)
            yield out

    return rows.mapInPandas(run, f"doc_id {kind}, {SPANS}")


def learn_names(docs: DataFrame, names: DataFrame, *, most_documents: int = tagger.MOST_DOCUMENTS, **settings: int) -> tagger.Weights:
    """A tagger trained on the listed names(type, name) where docs(doc_id,
    text) hold them; type may be ORGANIZATION too. Of names within names the
    longest is marked. The documents with names are counted first, so that
    the places are found in those alone that are learnt from."""
    filled = docs.select("doc_id", "text").filter("text <> ''")
    some = tagger.drawn(filled, names_.count_named(filled.select("text"), names), most_documents)
    keyed = some.withColumn("row", F.sha2("text", 256))
    hits = names_.find_names(keyed.select("row", "text").distinct(), names).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("hits"))

    def longest(hits: Column) -> Column:
        inside = lambda h: F.exists(hits, lambda o: (o.start <= h.start) & (o.end >= h.end) & (o.end - o.start > h.end - h.start))
        return F.filter(hits, lambda h: ~inside(h))

    known = keyed.join(hits, "row").select("doc_id", "text", longest(F.col("hits")).alias("spans"))
    return tagger.train(known, most_documents=None, **settings)


def renumbered(found: DataFrame) -> DataFrame:
    """Entities of an upload's records numbered through the upload, in the
    order of record, then of place in it. found has upload_id, record, place."""
    number = numbered(found, "record", "place", within="upload_id", name="_n")
    return number.withColumn("id", F.format_string("temp_%03d", F.col("_n"))).drop("_n")
