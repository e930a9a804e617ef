"""Exact betweenness and PageRank of graphs whose edges all touch few nodes (a
cover).

Let C be the cover, c nodes; no two other nodes are linked, so every path steps
into C at least every second node. Path lengths and counts between nodes of C
come from two c x c matrices: links within C, and how many other nodes link each
pair. A pair of other nodes s, t then lies 2 + d apart, d the least distance of
their neighbours in C, and has as many shortest paths as their neighbours at
that distance have. What betweenness needs of all pairs s, t at level d is one
c x c matrix,

    H_d[k, l] = sum of 1 / paths(s, t) over s next to k and t next to l,

summed over tiles of pairs; the rest is products of c x c matrices and one pass
over the nodes.

Rows of neighbours are dealt into blocks as packed bits. A task takes a tile of
two blocks, keeps one tile in memory and sends on its matrices alone, so what
moves is c bits a node for each block it meets; the time is nodes x nodes x c
multiplications. Nothing but c x c matrices reaches the driver or every task.
PageRank's rounds are walked on such matrices too (covered_pagerank).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquiro.storage import materialize

COVER, BLOCK = 512, 2048  # nodes of a cover at most; nodes of a block
CELLS = "level int, cell long, x double"


def cover_of(ends: DataFrame, most: int = COVER) -> list[int] | None:
    """Nodes that touch all edges of ends(from, to), both ways: of each edge the
    end of more edges, then the lower number. None if there are more than `most`."""
    degree = materialize(ends.groupBy("from").agg(F.count("*").alias("n")))
    both = ends.filter("from < to").join(degree.select("from", F.col("n").alias("m")), "from").join(degree.select(F.col("from").alias("to"), "n"), "to")
    found = both.select(F.when(F.col("m") >= F.col("n"), F.col("from")).otherwise(F.col("to")).alias("v")).distinct().limit(most + 1).collect()
    return sorted(r.v for r in found) if len(found) <= most else None


def _unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(n, -1), axis=1).astype(np.float64)


def _cells(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for level, of in sums.items():
        at = np.flatnonzero(of)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level, np.int32)), pa.array(at), pa.array(of.ravel()[at])], names=["level", "cell", "x"])


def _summed(cells: DataFrame, c: int) -> dict[int, np.ndarray]:
    """The matrices by level: c x c cells each at most."""
    out: dict[int, np.ndarray] = {}
    table = cells.groupBy("level", "cell").agg(F.sum("x").alias("x")).toArrow()
    level, cell, x = (table.column(k).to_numpy() for k in ("level", "cell", "x"))
    for k in np.unique(level):
        of = out.setdefault(int(k), np.zeros(c * c))
        of[cell[level == k]] = x[level == k]
    return {k: v.reshape(c, c) for k, v in out.items()}


def _paths(direct: np.ndarray, between: np.ndarray) -> list[np.ndarray]:
    """By length from 0: the number of shortest paths of that length between
    each pair of C, zero for pairs at other distances."""
    c = len(direct)
    paths, near = [np.eye(c)], np.eye(c, dtype=bool)
    while len(paths) < 3 or paths[-1].any() or paths[-2].any():
        new = paths[-1] @ direct + (paths[-2] @ between if len(paths) > 1 else 0)
        new[near] = 0
        near |= new > 0
        paths.append(new)
    while not paths[-1].any():
        paths.pop()
    return paths


def _levels(here: np.ndarray, there: np.ndarray, paths: list[np.ndarray], free: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(level, 1 / paths) of the pairs of rows that are free, each at the least
    level at which it has paths; there: rows, or the identity for C itself."""
    for level, of in enumerate(paths):
        if not of.any():
            continue
        counts = (here if level == 0 else here @ of) @ there.T
        counts[~free] = 0
        hit = counts > 0
        if hit.any():
            yield level, np.divide(1.0, counts, out=counts, where=hit)
            free = free & ~hit
            if not free.any():
                return


@dataclass
class Covered:
    """A graph by its cover: the links within it, and rows(v, bits) of the
    `outer` other nodes with edges: their neighbours, packed."""

    cover: list[int]
    direct: np.ndarray
    outer: int
    rows: DataFrame


def covered(ends: DataFrame, cover: list[int]) -> Covered:
    """Of ends(from, to), both ways."""
    spark, c = ends.sparkSession, len(cover)
    index = spark.createDataFrame([(v, k) for k, v in enumerate(cover)], "v long, k int")
    to = ends.join(F.broadcast(index.select(F.col("v").alias("to"), "k")), "to").select("from", "k")
    own = to.join(F.broadcast(index.select(F.col("v").alias("from"), F.col("k").alias("i"))), "from", "left")
    own = materialize(own.groupBy("from").agg(F.first("i").alias("i"), F.collect_list("k").alias("ks")))
    direct = np.zeros((c, c))
    for r in own.filter("i is not null").toLocalIterator():  # c rows of c numbers at most
        direct[r.i, r.ks] = 1.0
    outer = own.filter("i is null").select(F.col("from").alias("v"), "ks")
    packed_width = -(-c // 8)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ks")
            sizes, bits = np.diff(lists.offsets.to_numpy()), np.zeros((batch.num_rows, 8 * packed_width), np.uint8)
            bits[np.repeat(np.arange(batch.num_rows), sizes), lists.flatten().to_numpy()] = 1
            rows = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["v", "bits"])

    rows = materialize(outer.mapInArrow(pack, "v long, bits binary"))
    return Covered(cover, direct, rows.count(), rows)


def _slices(batches: Iterable[pa.RecordBatch], c: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most BLOCK rows, and their neighbours as numbers."""
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            yield part, _unpacked(b"".join(part.column("bits").to_pylist()), part.num_rows)[:, :c]


def covered_pagerank(graph: Covered, n: int, *, damping: float, rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    """(v, r) of the nodes with edges, and the rank of each of the others, of n
    nodes in all: after the first round that moves the ranks by less than the
    tolerance in all, or after `rounds`.

    A node outside the cover has its rank from the cover's ranks of the round
    before, so a round needs the cover's ranks of two rounds and two c x c
    matrices. All rounds are walked there; how far each moves the other nodes is
    summed in one pass over their rows.
    """
    spark, c, rows, direct = graph.rows.sparkSession, len(graph.cover), graph.rows, graph.direct

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, links = np.zeros((c, c)), np.zeros(c)
        for _, a in _slices(batches, c):
            shared += (a / a.sum(axis=1)[:, None]).T @ a
            links += a.sum(axis=0)
        yield from _cells({0: shared, 1: links})

    sums = _summed(rows.select("bits").mapInArrow(met, CELLS), c)
    zero = np.zeros((c, c))
    shared = sums.get(0, zero)  # of k and l: 1 / neighbours, summed over the nodes next to both
    links = direct.sum(axis=1) + sums.get(1, zero).ravel()[:c]
    idle = n - c - graph.outer
    base: list[float] = []  # what a node without edges has after each round
    ranks = [np.full(c, 1.0 / n)]
    for t in range(rounds):
        base.append((1 - damping) / n + damping * idle * (base[-1] if base else 1.0 / n) / n)
        others = np.diag(shared) * base[-2] + damping * (shared @ (ranks[-2] / links)) if t else np.diag(shared) / n
        ranks.append(base[-1] + damping * (direct @ (ranks[-1] / links) + others))
    sent = spark.sparkContext.broadcast((np.stack([r / links for r in ranks], axis=1), np.array(base)))

    def moved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (x, least), out = sent.value, np.zeros(rounds)
        for _, a in _slices(batches, c):
            after = least + damping * (a @ x[:, :-1])
            out += np.abs(np.diff(after, axis=1, prepend=1.0 / n)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds, dtype=np.int32)), pa.array(out)], names=["t", "x"])

    last = rounds
    if tolerance > 0 and rounds:
        shift = np.array([np.abs(ranks[t + 1] - ranks[t]).sum() for t in range(rounds)]) + idle * np.abs(np.diff(base, prepend=1.0 / n))
        for r in rows.select("bits").mapInArrow(moved, "t int, x double").groupBy("t").agg(F.sum("x").alias("x")).collect():  # a row a round
            shift[r.t] += r.x
        still = np.flatnonzero(shift < tolerance)
        last = int(still[0]) + 1 if len(still) else rounds

    def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, least = sent.value
        for part, a in _slices(batches, c):
            r = least[last - 1] + damping * (a @ x[:, last - 1]) if last else np.full(len(a), 1.0 / n)
            yield pa.RecordBatch.from_arrays([part.column("v"), pa.array(r)], names=["v", "r"])

    own = spark.createDataFrame(list(zip(graph.cover, ranks[last].tolist())), "v long, r double")
    return rows.select("v", "bits").mapInArrow(ranked, "v long, r double").unionByName(own), base[last - 1] if last else 1.0 / n


def covered_betweenness(graph: Covered, *, block: int = BLOCK) -> DataFrame:
    """(v, all): the sum over all ordered pairs, of which v is no end, of the
    share of their shortest paths that pass v. Nodes without edges are left out."""
    spark, c, cover, rows, direct = graph.rows.sparkSession, len(graph.cover), graph.cover, graph.rows, graph.direct
    blocks = max(1, -(-graph.outer // block))
    tiles = materialize(rows.groupBy(F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("b")).agg(F.collect_list("bits").alias("rows")))

    def dense(lists: pa.Array) -> list[np.ndarray]:
        return [_unpacked(b"".join(x.as_py()), len(x))[:, :c] for x in lists]

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((c, c))
        for batch in batches:
            for a in dense(batch.column("rows")):
                sums += a.T @ a
        yield from _cells({0: sums})

    between = _summed(tiles.select("rows").mapInArrow(linked, CELLS), c).get(0, np.zeros((c, c)))
    np.fill_diagonal(between, 0)
    paths = _paths(direct, between)
    sent = spark.sparkContext.broadcast(paths)

    def added(sums: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, free: np.ndarray, mirrored: bool, flag: int = 0) -> None:
        for level, share in _levels(a, b, sent.value, free):
            got = a.T @ share if flag else (a.T @ share) @ b
            at = 2 * level + flag
            sums[at] = sums.get(at, 0) + (got + got.T if mirrored else got)

    def to_cover(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for a in dense(batch.column("rows")):
                added(sums, a, np.eye(c), np.ones((len(a), c), bool), False, 1)
        yield from _cells(sums)

    def to_others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for x, y in zip(batch.column("rows"), batch.column("others"), strict=True):
                a, same = dense([x])[0], y.as_py() is None
                b = a if same else dense([y])[0]
                added(sums, a, b, ~np.eye(len(a), dtype=bool) if same else np.ones((len(a), len(b)), bool), not same)
        yield from _cells(sums)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # a tile of each pair of blocks that hold rows; a block with itself is sent once
    block_of = lambda end: tiles.select(F.col("b").alias(end), F.col("rows").alias(f"of_{end}"))
    held = tiles.select("b")
    wanted = held.select(F.col("b").alias("i")).join(held.select(F.col("b").alias("j")), F.col("i") <= F.col("j"))
    pairs = wanted.join(block_of("i"), "i").join(block_of("j"), "j").select("i", "j", F.col("of_i").alias("rows"), F.when(F.col("i") != F.col("j"), F.col("of_j")).alias("others")).repartition(4 * parts, "i", "j")
    of_cover = _summed(tiles.select("rows").mapInArrow(to_cover, CELLS), c)
    of_others = _summed(pairs.select("rows", "others").mapInArrow(to_others, CELLS), c)

    # C's nodes inside paths, and for the others what a pair of neighbours in C brings
    inside, brought = np.zeros(c), np.zeros((c, c))
    for level, reach in enumerate(paths):
        at = reach > 0
        # weights of pairs (k, l) with both ends beyond them, with l an end, with k and l the ends
        both, last = of_others.get(2 * level, np.zeros((c, c))) * at, of_cover.get(2 * level + 1, np.zeros((c, c))) * at
        alone = np.divide(1.0, reach, out=np.zeros((c, c)), where=at) if level else np.zeros((c, c))
        all_of = both + last + last.T + alone
        for k in range(level + 1):
            through = (last if k < level else 0) + (last.T if k else 0) + (alone if 0 < k < level else 0) + both
            inside += ((paths[k].T @ through) * paths[level - k]).sum(axis=1)
            if k + 2 <= level:
                brought += paths[k].T @ all_of @ paths[level - k - 2].T
    weights = spark.sparkContext.broadcast(brought)

    def within(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = _unpacked(b"".join(batch.column("bits").to_pylist()), batch.num_rows)[:, :c]
            off = weights.value - np.diag(np.diag(weights.value))
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(((a @ off) * a).sum(axis=1))], names=["v", "all"])

    return rows.select("v", "bits").mapInArrow(within, "v long, all double").unionByName(spark.createDataFrame(list(zip(cover, inside.tolist())), "v long, all double"))
