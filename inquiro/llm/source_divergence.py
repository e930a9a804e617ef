"""How far the sources of a language differ in their terms, by cube cells.

A term is a run of ASCII letters (A-Z lowered) and of characters beyond ASCII.
Each language keeps the terms that `least_documents` of its documents hold
(V of them). A group (a source of a language) and the language itself give a
kept term p = 1 + floor(scale * (count + smoothing) / (N + smoothing * V)),
with its count there and N, the sum of the counts of kept terms there.

Part `pair`: for two sources of a language the sum of abs(p - q) over all kept
terms. The table (source, source, term) is cut into cells by blocks of sources
and of terms. The slice of a block of sources and a block of terms goes to
every cell that needs it, once for each block of sources; a cell fills two
dense matrices, sums abs differences of their rows, and the sums of a pair's
cells are added along the terms. The number of cells follows from the numbers of
sources and terms, and each holds at most about two times `source_block` x
`term_block` numbers, whatever share of the rows a source, term or language has.
Part `term`: the `top` terms of a group that stand most above the language.

Counting is the only work on texts: tasks add up their own terms before the
shuffle. All arithmetic is on whole numbers (decimals where a long may not do).

Defined cases: null text, lang and source are empty texts; a group without
terms has p of count 0 everywhere; a language without kept terms has pairs of
value 0 and no term rows; a language of one source has no pairs; repeated rows
are documents of their own; equal values rank by the item's UTF-8 bytes;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inquiro.llm.common import as_bytes, materialize, text_slices

LEAST_DOCUMENTS, SCALE, SMOOTHING, TOP = 30, 1_000_000_000, 5, 50
SOURCE_BLOCK, TERM_BLOCK = 32, 8192
FLUSH = 200_000  # terms that a task holds before it passes their counts on
#: Bytes of terms, A-Z lowered; all others become blanks.
_KEEP = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def term_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n): occurrences of kept terms in each group."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in text_slices(batches):
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for group, text in zip(groups, as_bytes(batch), strict=True):
                words = terms_of(text)
                counts, documents = held.setdefault(group, (Counter(), Counter()))
                size -= len(counts)
                counts.update(words)
                documents.update(set(words))
                size += len(counts)
                if size >= FLUSH:
                    yield from flushed(held)
                    held, size = {}, 0
        yield from flushed(held)

    def flushed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, documents) in held.items():
            terms = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in terms], pa.int64()), pa.array([documents[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "documents"],
            )

    parts = docs.select(_text("lang"), _text("source"), "text").mapInArrow(count, "lang string, source string, term string, n long, documents long")
    each = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    in_lang = F.sum("documents").over(Window.partitionBy("lang", "term"))
    return each.withColumn("all", in_lang).filter(F.col("all") >= least_documents).select("lang", "source", "term", "n")


def _probability(count: str, total: str, kinds: str) -> Column:
    """1 + floor(SCALE * (count + s) / (total + s * kinds)), exactly."""
    over = f"cast({SCALE} as decimal(10,0)) * cast({count} + {SMOOTHING} as decimal(20,0))"
    return F.expr(f"case when {kinds} = 0 then 0 else 1 + (({over}) div cast({total} + {SMOOTHING} * {kinds} as decimal(20,0))) end")


def _cells(groups: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, part): differences of two groups over the terms
    of one cell, source and item in the order of their blocks.

    groups: lang, source, gb, gi, source_blocks, term_blocks, zero (p of no
    occurrence). terms: lang, term, tb, ti. counts: lang, source, term, p.
    """
    sizes = terms.groupBy("lang", "tb").agg(F.count("*").alias("width"))
    # every cell knows all its sources, by a row each
    rows = groups.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1))).join(sizes, ["lang", "tb"], "left")
    heads = rows.select("lang", "gb", "source_blocks", "tb", "gi", F.lit(-1).alias("ti"), F.col("zero").alias("p"), "source", F.coalesce("width", F.lit(0)).alias("width"))
    placed = counts.join(terms, ["lang", "term"]).join(groups.select("lang", "source", "gb", "gi", "source_blocks"), ["lang", "source"])
    values = placed.select("lang", "gb", "source_blocks", "tb", "gi", "ti", "p", F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("width"))
    slices = heads.unionByName(values).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1)))
    dealt = slices.select("lang", F.least("gb", "other").alias("bi"), F.greatest("gb", "other").alias("bj"), "tb", "gb", "gi", "ti", "p", "source", "width")

    def cell(key: tuple, rows: pa.Table) -> pa.Table:
        lang, bi, bj, _ = (k.as_py() for k in key)
        at, source, place, p = (rows.column(c).to_numpy() for c in ("gb", "gi", "ti", "p"))
        names, width = rows.column("source").to_pylist(), int(max(rows.column("width").to_pylist(), default=0))
        sides = []
        for block in dict.fromkeys((bi, bj)):
            heads, put = np.flatnonzero((at == block) & (place < 0)), np.flatnonzero((at == block) & (place >= 0))
            heads = heads[np.argsort(source[heads])]
            dense = np.repeat(p[heads][:, None], width, axis=1)
            dense[source[put], place[put]] = p[put]
            sides.append(([names[k] for k in heads], dense))
        (ours, left), (others, right) = sides[0], sides[-1]
        found: list[tuple[str, str, int]] = []
        for k, name in enumerate(ours):
            first = k + 1 if bi == bj else 0
            sums = np.abs(right[first:] - left[k]).sum(axis=1).tolist()
            found.extend((name, other, value) for other, value in zip(others[first:], sums, strict=True))
        columns = [[lang] * len(found), *[[f[k] for f in found] for k in range(3)]]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "source", "item", "part"])

    return dealt.groupBy("lang", "bi", "bj", "tb").applyInArrow(cell, "lang string, source string, item string, part long")


def divergence(docs: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, source_block: int = SOURCE_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank), as said above."""
    counts = materialize(term_counts(docs, least_documents))
    groups = docs.select(_text("lang"), _text("source")).distinct()
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    langs = of_lang.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n_lang").alias("total_lang"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # blocks by hash; places within a block by number, so that a window sees one block
    many = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left")
    blocks = many.select("lang", F.ceil(F.col("sources") / source_block).cast("int").alias("source_blocks"), F.greatest(F.lit(1), F.ceil(F.coalesce("kinds", F.lit(0)) / term_block)).cast("int").alias("term_blocks"), F.coalesce("kinds", F.lit(0)).alias("kinds"), F.coalesce("total_lang", F.lit(0)).alias("total_lang"))
    sized = groups.join(blocks, "lang").join(of_group, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    by_source = sized.withColumn("gb", F.pmod(F.xxhash64("source"), F.col("source_blocks")).cast("int"))
    zero = _probability("0", "total", "kinds")
    groups = materialize(by_source.select("*", (F.row_number().over(Window.partitionBy("lang", "gb").orderBy("source")) - 1).alias("gi"), zero.alias("zero")))
    by_term = of_lang.join(blocks, "lang").withColumn("tb", F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int"))
    terms = materialize(by_term.select("lang", "term", "tb", (F.row_number().over(Window.partitionBy("lang", "tb").orderBy("term")) - 1).alias("ti"), _probability("n_lang", "total_lang", "kinds").alias("q")))
    shares = counts.join(groups.select("lang", "source", "total", "kinds"), ["lang", "source"]).select("lang", "source", "term", _probability("n", "total", "kinds").alias("p"))

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        return rows.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))

    above = shares.join(terms.select("lang", "term", "q"), ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = ranked(above).filter(F.col("rank") <= top)
    halves = _cells(groups, terms.drop("q"), shares).groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = ranked(halves.select("lang", "value", F.explode(ways).alias("way")).select("lang", "way.source", "way.item", "value"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*names).unionByName(best.withColumn("part", F.lit("term")).select(*names))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM found f WHERE f.lang = g.lang AND f.source = g.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang)),
p AS (
  SELECT g.lang, g.source, term, coalesce(f.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 5)) // (g.total + 5 * g.v))::HUGEINT AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT p.lang, source, term AS item, p - (1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v)) AS value
  FROM p JOIN kept k USING (lang, term) JOIN langs l USING (lang) WHERE p.n > 0),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms WHERE value > 0)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 50"""
