"""Mixing sources to target weights by hash-threshold histograms.

A source's target is its share of the mix, water-filled below `most` times
its size. Each row has a hash of its id and text; a source takes the rows whose
hash lies below a threshold, so a larger budget always takes a superset. The
threshold is found without sorting: sizes are summed by source and bucket of
12 hash bits, running sums over those few buckets find the one where the
budget ends, and only the rows of that bucket are summed again by their next
12 bits, four times (48 bits). At the hash where the budget ends as many rows
are taken as come nearest to the target; that is one row or none, unless rows
repeat with id and text, which are alike, so any of them may go. Targets above a
source's size take every row once and repeat the rows below a threshold for
the rest.

Defined cases: null texts have size 0 and follow their hash; null sources
are one source, last in order; null ids hash like the text null; rows of one id
with other texts have hashes of their own; exact repeats at the threshold are
numbered by ranges and taken up to the budget; an empty table gives no rows;
other columns stay (mix) or are not read (plan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inquiro.llm.common import WORD, materialize
from inquiro.operators.numbering import numbered

WEIGHTS, FACTOR, MOST = (5, 2, 1), 1.5, 2.0
BITS, LEVELS = 12, 4


def row_hash(doc_id: Column, text: Column) -> Column:
    """48 bits of the md5 of the id and the text's md5."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sources: DataFrame, *, weights: tuple = WEIGHTS, factor: float = FACTOR, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a
    source. Filling by weight under caps raises all sources that are not at
    their cap to the same multiple of their weights; those with the least
    cap per weight fill first."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * most)
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (factor * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    filled = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    first_open = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(everything)
    return filled.withColumn("open_level", first_open).select("source", "source_size", F.when(F.col("full") | F.col("open_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("open_level") * F.col("w"))).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below, block, some): rows of (source, size, h) are taken while
    h < below, and `some` of the several rows of hash block, if it is set.
    budgets has source and budget; sources without rows get 0."""
    state = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("double").alias("spent"), "budget")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(state.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")))
        if level:
            inside = inside.filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket")  # 4096 buckets at most
        joined = (
            sums.join(state.select(F.col("source").alias("s"), "spent", "budget"), F.col("source").eqNullSafe(F.col("s")))
            .withColumn("upto", F.col("spent") + F.sum("size").over(run))
            .withColumn("before", F.col("upto") - F.col("size"))
        )
        ends = joined.filter(F.col("upto") > F.col("budget")).groupBy("source").agg(F.min_by(F.struct("bucket", "before", "upto", "n"), "bucket").alias("e"))
        state = materialize(
            state.join(ends.select(F.col("source").alias("s"), "e"), F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", F.coalesce("e.bucket", F.lit(1 << BITS * (level + 1)).cast("long")).alias("prefix"), F.coalesce("e.before", F.lit(0.0)).alias("spent"), "budget", F.col("e.upto").alias("upto"), F.col("e.n").alias("n")
            )
        )
    # of the n rows of the last hash as many as come nearest, of two the fewer
    each = (F.col("upto") - F.col("spent")) / F.col("n")
    some = F.coalesce(F.ceil((F.col("budget") - F.col("spent")) / each - 0.5), F.lit(0))
    several = F.coalesce(F.col("n") > 1, F.lit(False)) & (some > 0) & (some < F.col("n"))
    whole = F.coalesce(some >= F.col("n"), F.lit(False))
    return state.select("source", (F.col("prefix") + whole.cast("long")).alias("below"), F.when(several, F.col("prefix")).alias("block"), F.when(several, some).alias("some"))


def plan_mix(docs: DataFrame, *, weights: tuple = WEIGHTS, factor: float = FACTOR, most: float = MOST) -> DataFrame:
    """(source, source_size, target, copies, below, block, some): every row of
    a source is taken `copies` times and once more if its hash is less than
    `below`, or if it is one of the `some` taken of the repeats of hash `block`."""
    rows = materialize(docs.select("doc_id", "source", "text").select("source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h")))
    aims = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, factor=factor, most=most))
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    budgets = aims.select("source", (F.col("target") - whole * F.col("source_size")).alias("budget"))
    cuts = thresholds(rows, budgets).select(F.col("source").alias("s"), "below", "block", "some")
    more = F.col("target") > whole * F.col("source_size")
    return materialize(aims.withColumn("copies", whole.cast("int")).join(cuts, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", "copies", F.when(more, F.col("below")).otherwise(0).alias("below"), F.when(more, F.col("block")).alias("block"), F.when(more, F.col("some")).alias("some")))


def taken_times(docs: DataFrame, plan: DataFrame, names: dict[str, str]) -> DataFrame:
    """docs with the plan's columns under `names` and `times` (0 or more)."""
    inner = ["_mix_s", "_mix_size", "_mix_target", "_mix_copies", "_mix_below", "_mix_block", "_mix_some"]
    own = plan.select("source", "source_size", "target", "copies", "below", "block", "some").toDF(*inner)
    hashed = docs.join(own, F.col("source").eqNullSafe(F.col("_mix_s")), "left").select(*[docs[c] for c in docs.columns], *inner[1:], row_hash(F.col("doc_id"), F.col("text")).alias("_mix_h"))

    def times(rows: DataFrame, extra: Column) -> DataFrame:
        values = {"source_size": F.col("_mix_size"), "target": F.col("_mix_target"), "times": F.col("_mix_copies") + extra}
        return rows.select(*docs.columns, *[values[k].alias(v) for k, v in names.items()])

    below = F.when(F.col("_mix_h") < F.col("_mix_below"), 1).otherwise(0)
    if not plan.filter("block is not null").take(1):
        return times(hashed, below)
    # repeats are alike, so they are numbered in any order, by ranges of a draw
    at_block = F.coalesce(F.col("_mix_h") == F.col("_mix_block"), F.lit(False))
    repeats = numbered(hashed.filter(at_block).withColumn("_mix_draw", F.rand(1)), "_mix_block", "_mix_draw", within="_mix_block", name="_mix_n")
    return times(hashed.filter(~at_block), below).unionByName(times(repeats, F.when(F.col("_mix_n") <= F.col("_mix_some"), 1).otherwise(0)))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    plan = plan_mix(docs, **options)
    own = docs.select("doc_id", "source", "text")
    return taken_times(own, plan, {"source_size": "source_size", "target": "target", "times": "times"}).select("doc_id", size.alias("size"), "source_size", "target", (size * F.col("times")).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    n = taken_times(docs, plan_mix(docs, **options), {"times": "_mix_times"}).filter("_mix_times > 0")
    return n.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), "_mix_times"))).select(*docs.columns)


#: DuckDB's form of mix_report() over documents: the running sum in hash order
#: takes the place of the histograms.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', md5(coalesce(text, '')))), 1, 12)) AS BIGINT) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl FROM s1),
s3 AS (SELECT *, lvl * w >= cap AS isfull FROM s2),
s4 AS (SELECT *, CASE WHEN isfull OR (SELECT count(*) FROM s3 WHERE NOT isfull) = 0 THEN cap
  ELSE least(cap, (SELECT arg_min(lvl, cap / w) FROM s3 WHERE NOT isfull) * w) END AS target FROM s3),
s5 AS (SELECT *, floor(target / greatest(source_size, 1)) AS whole FROM s4),
g AS (SELECT source, h, sum(size) AS sz, count(*) AS n FROM d GROUP BY source, h),
r AS (SELECT g.source, g.h, g.n, s5.target - whole * source_size AS budget, sum(sz) OVER (PARTITION BY g.source ORDER BY g.h) AS upto, sz
  FROM g JOIN s5 ON g.source IS NOT DISTINCT FROM s5.source),
t AS (SELECT source, h, CASE WHEN upto <= budget THEN n ELSE ceil((budget - (upto - sz)) / (sz / n) - 0.5) END AS some FROM r WHERE upto - sz <= budget),
k AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS n FROM d)
SELECT k.doc_id, k.size, s5.source_size, s5.target, CAST(k.size * (s5.whole + CASE WHEN k.n <= t.some THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k JOIN s5 ON k.source IS NOT DISTINCT FROM s5.source LEFT JOIN t ON t.source IS NOT DISTINCT FROM k.source AND t.h = k.h
  AND s5.target > s5.whole * s5.source_size
"""
