"""Near copies by SimHash: wide fingerprints, bands of their bits, exact check.

A text is the set of its shingles (48 bits each, mixed from hashes of
their words); texts of equal sets are one node. A node's fingerprint has BITS bits, each the majority over its
shingles of one bit of their hashes. Two sets of similarity 0.8 differ in a share
of 0.15 of the bits (arc cosine of 8/9, over pi), unlike ones in half. Nodes that
agree in all `k` bits of a band meet, and are candidates if their first CHECK bits
differ in at most NEAR. k grows with the logarithm of the number of nodes, so
that a band's bucket holds about BUCKET chance nodes at every size, and there
are so many bands that a pair of 0.8 meets in none with probability 1e-4 or so
(bands share bits, and small sets vary more: tests hold recall to 0.99). A
bucket above `tile` nodes is split, and all pairs of its parts are compared.
Links that FIRST bands give are joined before the other bands are compared, so
a group that meets in every band is linked about FIRST times, not once a band.

Candidates' components are dealt into tiles of at most about `tile` nodes; each
pair of nodes of a component is compared exactly, and only pairs that reach the
similarity link, so a chance candidate links nothing. A row returns a spanning
forest of its links; a row of two parts only the links that join what the parts'
own links leave apart, so a dense group gives one a pair of parts. Components
come from alternating stars.

Cost: nodes x bands x BUCKET comparisons of 128 bits; a candidate component of m
nodes takes m^2 exact ones in (m / tile)^2 rows. The sets of candidates are made
from their texts anew, not stored for all documents.

Defined cases: null or wordless texts are one node without candidates; fewer
words than a shingle make one shingle; a component whose ids are all null has
a null id; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquiro.llm.common import as_bytes, materialize, text_slices
from inquiro.operators.stars import components

SHINGLE, SIMILARITY, SEED, TILE = 5, 0.8, 42, 512
BITS, CHECK, NEAR, BUCKET, MISS, SHARE = 512, 128, 38, 256, 1e-4, 0.16  # SHARE of bits that a pair at the radius may differ in
FIRST = 4  # bands whose links are joined before the others are compared
_BLOCK, _LANE, _RUNS = 1 << 13, 255, 1 << 12  # shingles whose bits are counted at once; most that a lane of 8 bits counts; sets that are counted at once
_COLUMNS = 8192  # shingles compared at once


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 of each shingle, repeats included."""
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed=SEED)] if words else []
    return [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), seed=SEED) for i in range(len(words) - size + 1)]


_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_ODD, _OF_BYTE = 0x9E3779B97F4A7C15, np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, in their order, and how many each text
    has. A word's hash is mixed from the sum of its bytes' numbers times powers
    of an odd number, by sums that run over all bytes."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
    starts, ends = edges[::2], edges[1::2]
    power = np.full(len(data), _ODD, dtype=np.uint64)
    power[0] = 1
    below = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_OF_BYTE[data] * np.multiply.accumulate(power), out=below[1:])
    power[1:] = pow(_ODD, -1, 1 << 64)
    own = (below[ends] - below[starts]) * np.multiply.accumulate(power)[starts]
    places = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return _mixed(own), np.diff(np.searchsorted(starts, places))


def shingle_sets(batch: pa.RecordBatch, size: int) -> tuple[list[np.ndarray], pa.Array]:
    """The sorted shingle set of each text, and a hash of each set. Words are
    hashed, and shingles mixed from them, for all texts of the batch at once."""
    flat, sizes = _word_hashes(as_bytes(batch))
    made = np.zeros(max(0, len(flat) - size + 1), dtype=np.uint64)
    for i in range(size):
        made = made * np.uint64(_ODD) + flat[i : i + len(made)]
    made = _mixed(made) >> np.uint64(16)
    sets, at = [], 0
    for n in sizes.tolist():
        if n >= size:
            own = np.sort(made[at : at + n - size + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            sets.append(np.array([xxhash.xxh64_intdigest(flat[at : at + n].tobytes(), seed=SEED)] if n else [], dtype=np.uint64) >> np.uint64(16))
        at += n
    return sets, pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), seed=SEED) for s in sets], dtype="<u8").view(np.int64))


#: The bits of a byte, each in a lane of 8 bits of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _spread_bits(shingles: np.ndarray) -> np.ndarray:
    """BITS bits of each shingle, in bytes."""
    flips = np.random.default_rng(SEED).integers(1, 1 << 63, BITS // 64, dtype=np.uint64)
    return _mixed(shingles[:, None] ^ flips).astype("<u8", copy=False).view(np.uint8)


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """BITS bits of each set, packed; no set may be empty. The least shingle
    decides ties. Bits are counted eight at a time, in the lanes of one number,
    over stretches that a lane can count."""
    out = []
    for low in range(0, len(sets), _RUNS):
        some = sets[low : low + _RUNS]
        flat, sizes = np.concatenate(some), np.array([len(s) for s in some], dtype=np.int64)
        ends, parts = np.cumsum(sizes), -(-sizes // _LANE)
        of = np.repeat(np.arange(len(some)), parts)  # the set of each stretch
        starts = (ends - sizes)[of] + _LANE * (np.arange(len(of)) - (np.cumsum(parts) - parts)[of])
        stops = np.append(starts[1:], len(flat))
        votes, i = np.zeros((len(some), BITS), dtype=np.int64), 0
        while i < len(of):
            j = max(i + 1, int(np.searchsorted(stops, starts[i] + _BLOCK, side="right")))
            lanes = np.add.reduceat(_LANES[_spread_bits(flat[starts[i] : stops[j - 1]])], starts[i:j] - starts[i], axis=0)
            begun = np.flatnonzero(np.diff(of[i:j], prepend=-1))
            votes[of[i:j][begun]] += np.add.reduceat(lanes.view(np.uint8), begun, axis=0, dtype=np.int64)
            i = j
        first = np.unpackbits(_spread_bits(flat[ends - sizes]), axis=1, bitorder="little")
        out.append(np.packbits(2 * votes + first > sizes[:, None], axis=1, bitorder="little"))
    return np.concatenate(out) if out else np.zeros((0, BITS // 8), np.uint8)


def bands_of(nodes: int) -> np.ndarray:
    """For so many nodes, the places of the bits of each band."""
    k = max(8, math.ceil(math.log2(max(1, nodes) / BUCKET)))
    bands = math.ceil(math.log(MISS) / math.log(1 - (1 - SHARE) ** k))
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(BITS, k, replace=False) for _ in range(bands)])


def keyed_bands(nodes: DataFrame, places: np.ndarray) -> DataFrame:
    """(key, fp, root, s0, s1) of nodes(fp, bits, root) for each band; s0, s1:
    CHECK bits."""
    bands, k = places.shape

    def cut(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                packed = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(packed, axis=1, bitorder="little").astype(np.int64)
                key = np.stack([bits[:, p] @ (1 << np.arange(k)) + (b << k) for b, p in enumerate(places)], axis=1)
                check = np.ascontiguousarray(packed[:, : CHECK // 8]).view("<i8")
                own = (part.column("fp").to_numpy(), part.column("root").to_numpy(), check[:, 0], check[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *[pa.array(np.repeat(x, bands)) for x in own]], names=["key", "fp", "root", "s0", "s1"])

    return nodes.select("fp", "bits", "root").mapInArrow(cut, "key long, fp long, root long, s0 long, s1 long")


def _near(tiles: DataFrame) -> DataFrame:
    """(a, b): links between roots that join all candidates among the nodes of
    each row of tiles(nodes, own)."""

    def compare(batches):
        for batch in batches:
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for row, own in zip(batch.column("nodes"), batch.column("own").to_pylist()):
                root, s0, s1 = (row.values.field(c).to_numpy().view(np.uint64) for c in ("root", "s0", "s1"))
                if (root == root[0]).all():
                    continue
                apart = np.bitwise_count(s0[:, None] ^ s0) + np.bitwise_count(s1[:, None] ^ s1)
                u, v = joins(root, own, *np.nonzero(np.triu(apart <= NEAR, 1)))
                a.append(u)
                b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return tiles.select("nodes", "own").mapInArrow(compare, "a long, b long")


def _band_links(nodes: DataFrame, places: np.ndarray, tile: int) -> DataFrame:
    """(a, b): links between roots that join the candidates of these bands."""
    keyed = keyed_bands(nodes, places)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = keyed.join(materialize(sizes), "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile)))
    tiles = materialize(dealt.groupBy("key", "part").agg(F.first("n").alias("n"), F.collect_list(F.struct("root", "s0", "s1")).alias("nodes")))
    split = tiles.filter(F.col("n") > tile)
    other = split.select("key", F.col("part").alias("_part"), F.col("nodes").alias("_nodes"))
    deal = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = split.join(other, "key").filter("part < _part").repartition(deal, "key", "part", "_part").select(F.concat("nodes", "_nodes").alias("nodes"), F.size("nodes").alias("own"))
    return _near(tiles.select("nodes", F.lit(0).alias("own"))).unionByName(_near(across)).distinct()


def candidate_links(nodes: DataFrame, count: int, tile: int = TILE) -> DataFrame:
    """(a, b): links whose components hold all candidate pairs of nodes(fp, bits)."""
    bands = bands_of(count)
    first = materialize(_band_links(nodes.withColumn("root", F.col("fp")), bands[:FIRST], tile))
    rooted = nodes.join(components(first).withColumnRenamed("node", "fp"), "fp", "left")
    rooted = materialize(rooted.select("fp", "bits", F.coalesce("root", "fp").alias("root")))
    return first.unionByName(_band_links(rooted, bands[FIRST:], tile))


def _labels(nodes: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of so many places the least that the links i - j join it to."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of nodes that join all that the links i - j (places in
    nodes) join."""
    label = _labels(len(nodes), i, j)
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def joins(names: np.ndarray, own: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like forest(), of names that may repeat. Where the first `own` places are
    one part and the others another (own > 0), links within the parts are known:
    returned are those that join across what they leave apart."""
    nodes, at = np.unique(names, return_inverse=True)
    across = (i < own) != (j < own) if own else np.ones(len(i), bool)
    label = _labels(len(nodes), at[i[~across]], at[j[~across]])
    return forest(nodes, label[at[i[across]]], label[at[j[across]]])


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of all pairs of sets whose Jaccard similarity is enough."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column, owner = column.ravel(), np.repeat(np.arange(len(sets)), sizes)
    meets = often > 1  # a shingle of one set alone is in no intersection
    column, owner = (np.cumsum(meets) - 1)[column[meets[column]]], owner[meets[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + _COLUMNS]))
        held = np.zeros((len(sets), min(_COLUMNS, int(column[-1]) + 1 - low)), dtype=np.float32)
        held[owner[part], column[part] - low] = 1
        common += (held @ held.T).astype(np.int64)
    return np.nonzero(np.triu(common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9, 1))


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp, bits): fp names the shingle set, bits is its wide
    fingerprint, null for no shingles."""

    def sign(batches):
        for batch in text_slices(batches, limit=2 << 20):
            sets, fp = shingle_sets(batch, shingle)
            some = [s for s in sets if len(s)]
            bits = iter(wide_fingerprints(some) if some else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp, pa.array([next(bits).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "fp", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, fp long, bits binary")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(fp, shingles): six bytes a shingle."""

    def cut(batches):
        for batch in text_slices(batches, limit=2 << 20):
            sets, fp = shingle_sets(batch, shingle)
            yield pa.RecordBatch.from_arrays([fp, pa.array([s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in sets], pa.binary())], names=["fp", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(cut, "fp long, shingles binary")


def _unpacked(shingles: bytes) -> np.ndarray:
    out = np.zeros((len(shingles) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(shingles, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _links(tiles: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join all similar nodes of each row of tiles(nodes, own)."""

    def compare(batches):
        for batch in batches:
            for row, own in zip(batch.column("nodes"), batch.column("own").to_pylist()):
                nodes = row.values
                fps = nodes.field("fp").to_numpy().view(np.uint64)
                a, b = joins(fps, own, *similar([_unpacked(s) for s in nodes.field("shingles").to_pylist()], similarity))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    return tiles.select("nodes", "own").mapInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, fp (names its shingle set) and
    component_id, the least doc_id reachable over pairs of the similarity."""
    signed = materialize(_signed(docs, shingle))
    nodes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits")))
    links = candidate_links(nodes.filter("bits is not null"), nodes.count(), tile)
    candidates = materialize(components(links).withColumnRenamed("node", "fp"))
    parts = candidates.groupBy("root").agg(F.ceil(F.count("*") / tile).alias("parts"))
    dealt = materialize(candidates.join(parts, "root").select("fp", "root", F.pmod(F.xxhash64("fp"), "parts").alias("part")))
    wanted = dealt.join(nodes, "fp").select(F.col("least").alias("_least")).distinct()
    texts = docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi")
    sets = _sets(texts, shingle).dropDuplicates(["fp"])
    tiles = materialize(sets.join(dealt, "fp").groupBy("root", "part").agg(F.collect_list(F.struct("fp", "shingles")).alias("nodes")))
    other = tiles.select("root", F.col("part").alias("_part"), F.col("nodes").alias("_nodes"))
    across = tiles.join(other, "root").filter("part < _part").select(F.concat("nodes", "_nodes").alias("nodes"), F.size("nodes").alias("own"))
    links = _links(tiles.select("nodes", F.lit(0).alias("own")), similarity).unionByName(_links(across, similarity))
    roots = components(links).select(F.col("node").alias("fp"), "root")
    rooted = materialize(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return signed.select("doc_id", "fp").join(rooted.join(least, "root").select("fp", "component_id"), "fp")


def with_set_name(rows: DataFrame, shingle: int) -> DataFrame:
    """rows(..., text) with the column fp, as near_copies() gives it."""

    def sign(batches):
        for batch in text_slices(batches, limit=2 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, shingle_sets(batch, shingle)[1]], names=[*batch.schema.names, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(sign, schema + ", fp long")
