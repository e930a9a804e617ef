"""Repeated lines: which lines of each document stay, as bitmaps.

A line's key is the line without ASCII white space at its ends, A-Z lowered.
A key of at least `least_length` code points that at least `least_documents`
documents hold keeps its lines in the largest doc_id alone; all other lines
stay. The method: one row for each document and distinct key (128-bit hash,
places of its lines); rows are range-partitioned and sorted by hash, then by
document from the largest down, then by place. One stream a partition numbers
the documents of a key: the first keeps its lines, from the second on they go
as soon as a third one shows. A key that holds a great share of all rows spans
several ranges: rows of a range's first key, and a second document at a
range's end, wait for the counts of the neighbouring ranges, of which there
are two rows a range. What is left are the places of dropped lines, gathered
for each document into a packed, compressed bitmap; no text is moved.

Defined cases: a null or empty text is one empty line; empty lines and short
keys always stay; rows of one doc_id count as one document (their lines with
the largest id's key all stay); a null doc_id is one document below all
others; a key's repeats inside the document that keeps it stay; rows repeated
with id and text share one bitmap; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from inquiro.llm.common import arrow_type, as_bytes, materialize, text_slices

LEAST_LENGTH, LEAST_DOCUMENTS = 20, 3
SPACE = b" \t\n\v\f\r"


def line_keys(text: bytes, least_length: int = LEAST_LENGTH) -> tuple[int, dict[bytes, list[int]]]:
    """How many lines a text has, and the places of each long enough key."""
    lines, places = text.split(b"\n"), {}
    for place, line in enumerate(lines):
        key = line.strip(SPACE)
        if len(key) >= least_length and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_length):
            places.setdefault(key.lower(), []).append(place)
    return len(lines), places


def _key_rows(docs: DataFrame, least_length: int) -> DataFrame:
    """(h1, h2, doc_id, text_hash, n_lines, places) a document and key."""
    id_type = docs.schema["doc_id"].dataType
    schema = StructType().add("h1", LongType()).add("h2", LongType()).add("doc_id", id_type).add("text_hash", LongType()).add("n_lines", IntegerType()).add("places", ArrayType(IntegerType(), False))
    types = [arrow_type(f.dataType) for f in schema]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            digests, of, counts, places, sizes = [], [], [], [], []
            for k, text in enumerate(as_bytes(batch)):
                n, found = line_keys(text, least_length)
                for key, at in found.items():
                    digests.append(hashlib.blake2b(key, digest_size=16).digest())
                    places.extend(at)
                    sizes.append(len(at))
                of.extend([k] * len(found))
                counts.extend([n] * len(found))
            halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            at, offsets = pa.array(of, pa.int64()), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32()))
            columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(counts, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(rows, schema)


DROPPED, WAITS, EDGE = "dropped", "waits", "edge"


def _streamed(keys: DataFrame, least_documents: int) -> DataFrame:
    """One row for each dropped or undecided row of `keys`, and two a range
    (state edge) that say how many documents its first and last key have.
    `rank` numbers the documents of a key within the range."""
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("places")[0]]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order, "text_hash").withColumn("part", F.spark_partition_id())
    schema = StructType([*ranged.schema.fields]).add("state", StringType()).add("rank", LongType())
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    def picked(batch: pa.RecordBatch, at: np.ndarray, state: str, ranks: np.ndarray) -> pa.RecordBatch:
        rows = batch.take(pa.array(at))
        extra = [pa.array([state] * len(at), pa.string()), pa.array(ranks[at])]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*rows.columns, *extra], arrow, strict=True)], schema=arrow)

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, key, doc, rank, in_first = False, None, None, 0, True
        held: list[pa.RecordBatch] = []  # rows of the present key that go if enough documents follow
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            ids = batch.column("doc_id")
            new_key = np.ones(n, bool)
            new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_key[0] = not begun or key != (h1[0], h2[0])
            codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new_doc = new_key.copy()
            new_doc[1:] |= codes[1:] != codes[:-1]
            new_doc[0] = new_key[0] or ids[0].as_py() != doc
            total = np.cumsum(new_doc)
            starts = np.flatnonzero(new_key)
            group = np.cumsum(new_key)  # 0: goes on from the batch before
            base = np.concatenate([[-rank], total[starts] - 1])
            ranks = (total - base[group]).astype(np.int64)
            ends = np.append(starts[1:] - 1, n - 1) if len(starts) else np.array([n - 1])
            if len(starts) and starts[0] > 0:
                ends = np.concatenate([[starts[0] - 1], ends])
            begun, groups = True, np.unique(group)
            most = dict(zip(groups.tolist(), ranks[ends].tolist(), strict=True))
            for g in groups[:1]:  # the key that goes on, or the range's first
                rows = np.flatnonzero(group == g)
                if g == 1 and last is not None:  # the key before has ended: what it held stays
                    if in_first:
                        yield picked(last[0], np.array([0]), EDGE, last[1])
                    in_first, held = False, []
                if in_first:
                    yield picked(batch, rows, WAITS, ranks)
                    if len(groups) > 1:
                        yield picked(batch, rows[-1:], EDGE, ranks)
                elif most[int(g)] >= least_documents:
                    yield from (with_state(b, DROPPED) for b in held)
                    held = []
                    rows = rows[ranks[rows] >= 2]
                    yield picked(batch, rows, DROPPED, ranks)
                else:
                    held.append(picked(batch, rows[ranks[rows] >= 2], WAITS, ranks))
            if len(groups) > 1:
                in_first = False
                sizes = np.array([most.get(int(g), 0) for g in range(int(group[-1]) + 1)])
                inner = (group > groups[0]) & (ranks >= 2)
                gone = np.flatnonzero(inner & (sizes[group] >= least_documents))
                if len(gone):
                    yield picked(batch, gone, DROPPED, ranks)
                tail = np.flatnonzero(inner & (group == group[-1]) & (sizes[group] < least_documents))
                held = [picked(batch, tail, WAITS, ranks)]
            key, doc, rank = (h1[-1], h2[-1]), ids[n - 1].as_py(), int(ranks[-1])
            last = (batch.slice(n - 1, 1), np.array([rank], np.int64))
        if last is not None:
            yield from held
            yield picked(last[0], np.array([0]), EDGE, last[1])

    def with_state(batch: pa.RecordBatch, state: str) -> pa.RecordBatch:
        return batch.set_column(batch.schema.get_field_index("state"), "state", pa.array([state] * batch.num_rows, pa.string()))

    return ranged.mapInArrow(stream, schema)


def dropped_lines(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, text_hash, n_lines, places): lines that go, a row for each
    document and key. least_documents must be 2 or more."""
    if least_documents < 2:
        raise ValueError("least_documents must be 2 or more")
    out = materialize(_streamed(materialize(_key_rows(docs, least_length)), least_documents))
    # two rows a range at most: documents of its first and last key
    of_key = Window.partitionBy("h1", "h2")
    before = F.sum("rank").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    around = out.filter(F.col("state") == EDGE).select("part", "h1", "h2", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rank").over(of_key).alias("all"))
    waiting = out.filter(F.col("state") == WAITS).join(F.broadcast(around), ["part", "h1", "h2"])
    late = waiting.filter((F.col("before") + F.col("rank") >= 2) & (F.col("all") >= least_documents))
    names = ["doc_id", "text_hash", "n_lines", "places"]
    return out.filter(F.col("state") == DROPPED).select(*names).unionByName(late.select(*names))


def keep_bitmaps(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep) for each document that
    loses lines; keep is packed (unpack() reads it), text_hash Spark's
    xxhash64 of the text. Documents without a row keep every line."""
    gone = dropped_lines(docs, least_length=least_length, least_documents=least_documents)
    each = gone.groupBy("doc_id", "text_hash", "n_lines").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    schema = StructType([each.schema["doc_id"]]).add("text_hash", LongType()).add("n_lines", IntegerType()).add("n_dropped", LongType()).add("keep", BinaryType())

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keeps, counts = [], []
            for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("places"), strict=True):
                at = np.asarray(places.values)
                keeps.append(pack(n, at))
                counts.append(len(at))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "text_hash", "n_lines")], pa.array(counts, pa.int64()), pa.array(keeps, pa.binary())], names=schema.names)

    return each.mapInArrow(packed, schema)


def pack(n_lines: int, dropped: np.ndarray) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    """The bitmap as booleans, true for a line that stays."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines, bitorder="little").astype(bool)


def kept_text(text: bytes, keep: bytes | None) -> bytes:
    if keep is None:
        return text
    lines = text.split(b"\n")
    return b"\n".join(line for line, stays in zip(lines, unpack(keep, len(lines)), strict=True) if stays)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, *columns: str) -> DataFrame:
    """The documents' columns (all, unless some are named) and `keep`, null
    where every line stays. Texts are dealt by id and hash, not sorted."""
    left = docs.select(*(columns or docs.columns), F.xxhash64("text").alias("_hash")).alias("d")
    right = bitmaps.select("doc_id", "text_hash", "keep").hint("shuffle_hash").alias("k")
    joined = left.join(right, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d._hash") == F.col("k.text_hash")), "left")
    return joined.select("d.*", "k.keep").drop("_hash")


def clean_documents(docs: DataFrame, **settings: int) -> DataFrame:
    """The documents without their repeated lines; other columns stay."""
    bitmaps, schema = materialize(keep_bitmaps(docs, **settings)), docs.schema
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"_{k}" for k, c in enumerate(docs.columns)])  # no clash with `keep`
    names = inner.columns
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    def applied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            present = batch.column("text").is_valid().to_pylist()
            texts = [kept_text(t, k).decode() if p else None for t, k, p in zip(as_bytes(batch), batch.column("keep").to_pylist(), present, strict=True)]
            columns = [pa.array(texts, pa.string()) if name == "text" else batch.column(name) for name in names]
            columns = [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return with_bitmaps(inner, bitmaps).mapInArrow(applied, schema)


def line_report(docs: DataFrame, **settings: int) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) a document."""
    bitmaps = materialize(keep_bitmaps(docs, **settings))
    schema = StructType([docs.schema["doc_id"]]).add("n_lines", LongType()).add("n_dropped", LongType()).add("kept_sha256", StringType())

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            lines, dropped, hashes = [], [], []
            for text, keep in zip(as_bytes(batch), batch.column("keep").to_pylist(), strict=True):
                n = text.count(b"\n") + 1
                lines.append(n)
                dropped.append(0 if keep is None else n - int(unpack(keep, n).sum()))
                hashes.append(hashlib.sha256(kept_text(text, keep)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(hashes, pa.string())], names=schema.names)

    return with_bitmaps(docs, bitmaps, "doc_id", "text").mapInArrow(digests, schema)


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
kept_in AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN kept_in USING (k) GROUP BY doc_id"""
