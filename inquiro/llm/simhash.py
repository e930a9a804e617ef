"""SimHash near-duplicates by tiled exact comparison.

A fingerprint's bit is 1 if it is set in over half of the text's shingle
hashes. Equal fingerprints are one node (its least doc_id stands for it), so
a group of copies of any size is one row here. Nodes are dealt into tiles by
their population counts over the four 16-bit quarters: two fingerprints
within the radius differ by at most the radius in the sum of those counts,
so all other tile pairs are skipped. Tiles of more than `tile` nodes are
split by hash. A task compares two tiles by exclusive-or and bit counts and
returns a spanning forest of the links it finds, not the links themselves:
no link is lost for the components, and a dense group costs no more rows
than it has nodes. Components come from alternating stars.

Defined cases: a null or wordless text has fingerprint zero and links like
any other; fewer words than a shingle make one shingle; a component whose
ids are all null has a null id; repeated rows give a row each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquiro.llm.common import as_bytes, materialize, text_slices
from inquiro.operators.stars import components
from inquiro.llm.near_copies import forest, near_copies, shingle_hashes, with_set_name
from inquiro.llm.near_copies import SHINGLE as STAGE_SHINGLE
from inquiro.llm.near_copies import SIMILARITY as STAGE_SIMILARITY

SHINGLE, RADIUS, TILE = 3, 2, 1024
_BLOCK = 1 << 17  # shingles whose bits are counted at once


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of `sizes` hashes."""
    votes = np.zeros((len(sizes), 64), dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for low in range(0, len(hashes), _BLOCK):
        high = min(low + _BLOCK, len(hashes))
        runs = np.flatnonzero((ends > low) & (starts < high) & (sizes > 0))
        bits = np.unpackbits(hashes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes[runs] += np.add.reduceat(bits, np.maximum(starts[runs] - low, 0), axis=0, dtype=np.int64)
    return np.packbits(2 * votes > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of each row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        for batch in text_slices(batches, limit=2 << 20):
            each = [shingle_hashes(t.lower().split(), shingle) for t in as_bytes(batch)]
            sizes = np.array([len(x) for x in each], dtype=np.int64)
            flat = np.array([h for x in each for h in x], dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(majority(flat, sizes).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, fp long")


def near_offsets(radius: int) -> list[int]:
    """Differences of tile keys (four counts, five bits each) that sum to at
    most the radius; of each pair of opposites the positive one."""
    steps = range(-radius, radius + 1)
    codes = {sum(d << 5 * i for i, d in enumerate(x)) for x in product(steps, repeat=4) if sum(map(abs, x)) <= radius}
    return sorted(c for c in codes if c >= 0)


def tile_forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join all fingerprints of two tiles which chains of
    pairs within the radius join; compares blocks of rows at a time."""
    found = []
    step = max(1, (1 << 20) // max(1, len(right)))
    for low in range(0, len(left), step):
        i, j = np.nonzero(np.bitwise_count(left[low : low + step, None] ^ right[None, :]) <= radius)
        i = i + low
        found.append((i[i < j], j[i < j]) if same else (i, j))
    i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    if not len(i):
        return left[:0], left[:0]
    nodes = left if same else np.concatenate([left, right])
    j = j if same else j + len(left)
    return forest(nodes, i, j)


def tiled_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links whose components are those of all pairs of the distinct
    fingerprints nodes(fp) that differ in at most `radius` bits."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    key = sum((q + 2 * radius).cast("long") * (1 << 5 * i) for i, q in enumerate(quarter))
    keyed = nodes.select("fp", key.alias("key"))
    parts = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).alias("parts"))  # 17^4 keys at most
    tiles = materialize(keyed.join(parts, "key").select("key", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"), "fp").groupBy("key", "part").agg(F.sort_array(F.collect_list("fp")).alias("fps")))
    left = tiles.select(F.explode(F.array(*[F.lit(c).cast("long") for c in near_offsets(radius)])).alias("off"), (F.col("key") + F.col("off")).alias("key"), F.col("part").alias("l_part"), F.col("fps").alias("l_fps"))
    pairs = left.join(tiles, "key").filter((F.col("off") > 0) | (F.col("l_part") <= F.col("part")))
    # one key may hold most tiles: its pairs are dealt anew, as comparisons outweigh their rows
    deal = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(deal, "key", "off", "l_part", "part").select("l_fps", "fps", ((F.col("off") == 0) & (F.col("l_part") == F.col("part"))).alias("same"))

    def compare(batches):
        for batch in batches:
            a, b = [], []
            for x, y, same in zip(batch.column("l_fps"), batch.column("fps"), batch.column("same").to_pylist()):
                u, v = tile_forest(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), radius, same)
                a.append(u)
                b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, fingerprint (hex), component_id
    (the least doc_id reachable over links) and fp (the fingerprint as long)."""
    signed = materialize(fingerprints(docs, shingle))
    nodes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(tiled_links(nodes.select("fp"), radius, tile)).select(F.col("node").alias("fp"), "root")
    rooted = materialize(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = rooted.join(least, "root").select("fp", "component_id")
    return signed.join(of_node, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def one_per_group(docs: DataFrame, *, shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, that stand for their group of
    near_copies(), SimHash with the stage's own settings: those with the least doc_id. Repeated rows of that id are
    one document; rows of one id whose shingle sets differ stand for
    themselves in their groups.

    Heads grow with the documents, so they are never broadcast: at every size
    texts are dealt by id once and meet a hash table of ids, unsorted."""
    judged = materialize(near_copies(docs, shingle=shingle, similarity=similarity).select("doc_id", "fp", "component_id"))
    heads = judged.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    heads = materialize(heads)
    single = docs.join(heads.filter("n = 1 and doc_id is not null").select(F.col("doc_id").alias("_head")).hint("shuffle_hash"), F.col("doc_id") == F.col("_head"), "left_semi")
    often = judged.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if often.limit(1).count() == 0:
        return single
    often = materialize(often.select("doc_id"))
    rows = docs.join(often.select(F.col("doc_id").alias("_often")), F.col("doc_id").eqNullSafe(F.col("_often")), "left_semi")
    signed = rows.select(*[F.col(c).alias(f"_of_{c}") for c in docs.columns], "doc_id", "text")
    kept = with_set_name(signed, shingle).dropDuplicates(["doc_id", "fp"])
    wanted = judged.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).distinct()
    kept = kept.join(wanted, kept.doc_id.eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left_semi").select(*[F.col(f"_of_{c}").alias(c) for c in docs.columns])
    once = docs.join(often.select(F.col("doc_id").alias("_often")), F.col("doc_id").eqNullSafe(F.col("_often")), "left_anti")
    return once.join(heads.select(F.col("doc_id").alias("_head")).hint("shuffle_hash"), F.col("doc_id") == F.col("_head"), "left_semi").unionByName(kept)
