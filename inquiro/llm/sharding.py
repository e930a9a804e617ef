"""Sharding by balanced label propagation.

Equal texts are one unit, documents that share a line are linked through
that line; every line with a word counts, common ones for less. A group of
equal texts larger than a shard is split into pieces by its documents'
hashes, so one with a third of all rows spreads over the shards it needs.
Smaller groups stay whole if the sizes come out even so (within `slack`);
if not, those above an eighth of a shard are split too and dealt again. Units start in hashed shards; in each round every line
takes the shard that holds most of its units' bytes, every unit asks for the
shard that most of its lines (and its text's other pieces) favour, and moves
under quotas: what flows from one shard to another is bounded by what flows
back and by the room under the capacity. Which units move is decided by hash
thresholds over a histogram of the wishes (shards x shards x 64 numbers, all
the driver sees). A last step moves surplus by the same kind of histogram
until sizes are even; that is the law "bytes": near-equal sizes.

Lines join units as a two-column table: no pair of documents is ever listed,
however many share a line. Slots are numbered per shard and hash bucket and
shifted by the buckets before, so no shard is gathered in one task.

Defined cases: a null text has size 1, checksum 0 and no lines, and is one
group with the other nulls; null ids hash like others; repeated rows are
rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inquiro.llm.common import WORD, materialize

SHARDS, ROUNDS, SLACK, PIECES = 16, 4, 0.03, (1, 8)
_WISHES, _EVEN, _SLOT_ROWS, _HOT_LINES = 64, 4096, 20_000, 1000


def _units(rows: DataFrame, total: int, n_shards: int, pieces: int) -> DataFrame:
    """rows with unit: of equal texts, those above 1 / pieces of a shard cut."""
    limit = max(1, total // (pieces * n_shards))
    large = rows.groupBy("grp").agg(F.sum("size").alias("all")).filter(F.col("all") > limit).select("grp", F.ceil(F.col("all") / limit).cast("long").alias("parts"))
    piece = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts")))
    # at most `pieces` groups a shard exceed the limit: the join's side is that small
    return rows.join(F.broadcast(large), "grp", "left").select("doc_id", "size", "text_crc32", "grp", F.xxhash64("grp", piece).alias("unit"))


def line_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(unit, line, part, parts, w): lines that two units or more hold, and a
    text's own node where it has several pieces; w is what a unit's vote
    counts. A line with over 1/1000 of all links is dealt into parts by its
    units' hashes, so joins on (line, part) spread it; there are at most 1000
    such lines, and parts over one at most 1000 in all."""
    line = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD))
    grp = F.xxhash64("text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    of_text = materialize(docs.select(grp.alias("grp"), F.explode(F.array_distinct(F.transform(line, lambda x: F.xxhash64(x)))).alias("line")).distinct())
    share = max(1, -(-of_text.count() // _HOT_LINES))
    shared = materialize(of_text.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1"))
    hot = F.broadcast(shared.filter(F.col("n") > share))  # at most _HOT_LINES rows
    often = of_text.join(hot, "line")
    rare = of_text.join(hot.select("line"), "line", "left_anti").join(shared.filter(F.col("n") <= share), "line")
    units = rows.select("grp", "unit").distinct()
    pieces = units.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / share).cast("int")
    by_line = often.unionByName(rare).join(units, "grp").select("unit", "line", F.pmod(F.hash("unit"), parts).alias("part"), parts.alias("parts"), (1.0 / F.log2(F.col("n") + 1)).alias("w"))
    by_piece = units.join(pieces, "grp").select("unit", F.col("grp").alias("line"), F.lit(0).alias("part"), F.lit(1).alias("parts"), F.lit(4.0).alias("w"))
    return by_line.unionByName(by_piece)


def _thresholds(moves: np.ndarray, loads: np.ndarray, capacity: float) -> np.ndarray:
    """Per (from, to) how many of the wish buckets may move. moves has the
    bytes by from, to and bucket."""
    n = len(loads)
    wish = moves.sum(axis=2)
    allowed = np.minimum(wish, wish.T)  # exchanges keep the loads
    room = np.maximum(capacity - loads, 0)
    more = wish - allowed
    share = np.divide(room, more.sum(axis=0), out=np.zeros(n), where=more.sum(axis=0) > 0)
    allowed += more * np.minimum(share, 1)[None, :]
    return (np.cumsum(moves, axis=2) <= allowed[:, :, None] + 1e-9).sum(axis=2)


def _table(spark, numbers: np.ndarray, names: list[str]) -> DataFrame:
    rows = [tuple(int(x) for x in i) + (int(numbers[i]),) for i in np.ndindex(numbers.shape)]
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))


def propagate(units: DataFrame, links: DataFrame, n_shards: int, rounds: int, slack: float) -> DataFrame:
    """(unit, size, shard) after the rounds and the evening."""
    spark = units.sparkSession
    state = materialize(units.select("unit", "size", F.pmod(F.xxhash64("unit", F.lit(-1)), F.lit(n_shards)).cast("int").alias("shard")))
    total = state.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    capacity = (1 + slack) * total / n_shards
    for k in range(rounds):
        votes = links.join(state, "unit").groupBy("line", "shard").agg(F.sum(F.col("w") * F.log2(F.col("size") + 1)).alias("v"), F.max("parts").alias("parts"))
        best = votes.groupBy("line").agg(F.max_by("shard", F.struct("v", "shard")).alias("shard"), F.max("parts").alias("parts"))
        best = best.select("line", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        wish = links.join(best, ["line", "part"]).groupBy("unit", "shard").agg(F.sum("w").alias("v")).groupBy("unit").agg(F.max_by("shard", F.struct("v", "shard")).alias("to"))
        bucket = F.pmod(F.xxhash64("unit", F.lit(k)), F.lit(_WISHES)).cast("int")
        wishes = materialize(state.join(wish, "unit").filter("to <> shard").select("unit", "size", F.col("shard").alias("from"), "to", bucket.alias("bucket")))
        moves, loads = np.zeros((n_shards, n_shards, _WISHES)), np.zeros(n_shards)
        for a, b, c, s in wishes.groupBy("from", "to", "bucket").agg(F.sum("size")).collect():  # bounded by the histogram
            moves[a, b, c] = s
        for a, s in state.groupBy("shard").agg(F.sum("size")).collect():
            loads[a] = s
        cuts = _table(spark, _thresholds(moves, loads, capacity), ["from", "to", "cut"])
        moved = wishes.join(F.broadcast(cuts), ["from", "to"]).filter("bucket < cut").select("unit", "to")
        state = materialize(state.join(moved, "unit", "left").select("unit", "size", F.coalesce("to", "shard").alias("shard")))
    return _even(state, n_shards)


def _even(state: DataFrame, n_shards: int) -> DataFrame:
    """Move the first hash buckets of the shards above the mean to those
    below, as far as that brings the sizes nearer."""
    spark = state.sparkSession
    state = state.withColumn("bucket", F.pmod(F.xxhash64("unit", F.lit(-2)), F.lit(_EVEN)).cast("int"))
    hist = np.zeros((n_shards, _EVEN))
    for a, b, s in state.groupBy("shard", "bucket").agg(F.sum("size")).collect():  # bounded by the histogram
        hist[a, b] = s
    loads, goal, to = hist.sum(axis=1), hist.sum() / n_shards, []
    for b in np.argsort(-hist.max(axis=0), kind="stable").tolist():  # the largest first
        for a in np.flatnonzero((hist[:, b] > 0) & (loads > goal)):
            low = int(loads.argmin())
            if loads[low] + hist[a, b] < loads[a]:
                to.append((int(a), b, low))
                loads[a] -= hist[a, b]
                loads[low] += hist[a, b]
                hist[a, b] = 0
    moves = spark.createDataFrame(to, "shard int, bucket int, to int")
    return materialize(state.join(F.broadcast(moves), ["shard", "bucket"], "left").select("unit", F.coalesce("to", "shard").alias("shard")))


def number_slots(rows: DataFrame) -> DataFrame:
    """rows(doc_id, size, text_crc32, shard) with slot, gapless from 0."""
    buckets = max(1, rows.count() // _SLOT_ROWS)
    rows = rows.withColumn("b", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("shard", "b").agg(F.count("*").alias("n")).select("shard", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "b").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("k", F.row_number().over(inside) - 1).join(base, ["shard", "b"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("k")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, *, n_shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, size, text_crc32, law, shard,
    slot and grown_shard (null under this law)."""
    docs = docs.select("doc_id", "text")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = materialize(docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64("text", F.crc32(data)).alias("grp")))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    for pieces in PIECES:
        rows = materialize(_units(sized, total, n_shards, pieces))
        links = materialize(line_links(docs, rows))
        units = rows.groupBy("unit").agg(F.sum("size").alias("size"))
        placed = propagate(units, links, n_shards, rounds, slack)
        sharded = materialize(rows.join(placed, "unit").select("doc_id", "size", "text_crc32", "shard"))
        loads = [r[0] for r in sharded.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]  # n_shards rows
        if max(loads, default=0) <= (1 + slack) * total / n_shards:
            break
    return number_slots(sharded).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
