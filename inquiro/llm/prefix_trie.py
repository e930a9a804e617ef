"""The trie of conversation prefixes, from whole sequences collapsed first.

Conversations share openings. Each is rebuilt here with the opening of a base
conversation; every distinct sequence of first turns is then a node. The
method: a prefix is known by 128 bits, the exclusive or of hashes of (place,
role, text) of its turns, which are running sums over sorted ranges.
Conversations whose whole sequence is the same collapse to one weighted
sequence with a list of its ends; a sequence that is a proper prefix of
another (an anti-join of whole sequences with the proper prefixes of all) is
no leaf; only the prefixes of distinct sequences are then added up, with their
weights. Sums over subtrees need no walk: each node's value is laid on one
sequence through it, the running sums of a sequence from its deepest place up
hold all that lies at or below a place, and a node adds the sums of the
sequences through it.

No conversation is gathered: long ones span ranges. The ends of a sequence are
cut into chunks of text by sorted ranges; SHA-256 has to read a list in order, so
one stream a sequence reads its chunks, of which it holds one at a time.

Defined cases: turns are in order of turn (null first), then role and text;
null role or text is empty; rows of a null conv_id belong to no conversation
and are left out; repeated rows are turns of their own; a conversation that
loses all its turns in rebuilding is a member of the root alone; an empty table
has no conversation and gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from inquiro.llm.common import WORD, materialize
from inquiro.llm.ranges import running

BLOCK, HEADS = 20, 4  # conversations of a base; a head has less than this many turns
CHUNK = 4096  # ids of a chunk of an end list
EMPTY = hashlib.sha256(b"").hexdigest()


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def _base(conv_id: Column) -> Column:
    return conv_id - conv_id % BLOCK


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): the turns of the rebuilt conversations as (conv_id,
    depth, a, b, words), a and b a digest of role and text, and (conv_id,
    length) of every conversation."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.lit(1).cast("long").alias("one"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")  # noqa: E731  60 bits each
    hashed = rows.select("conv_id", "turn", "role", "text", "one", half(1).alias("a"), half(16).alias("b"), F.size(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).cast("long").alias("words"))
    numbered = materialize(running(hashed, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], sums=["one"], drop=["turn", "role", "text", "one"]).withColumnRenamed("run_one", "place"))
    own = numbered.groupBy("conv_id").agg(F.max("place").alias("turns"))
    heads = numbered.filter((F.col("conv_id") % BLOCK == 0) & (F.col("place") < HEADS))
    lengths = heads.groupBy(F.col("conv_id").alias("base")).agg(F.max("place").alias("lent"))
    convs = own.select("conv_id", "turns", head_length(F.col("conv_id")).alias("h"), _base(F.col("conv_id")).alias("base")).join(lengths, "base", "left")
    convs = materialize(convs.select("conv_id", "base", "turns", "h", F.least("h", F.coalesce("lent", F.lit(0))).cast("long").alias("lent")))
    inherited = convs.alias("c").join(heads.alias("t"), (F.col("c.base") == F.col("t.conv_id")) & (F.col("t.place") <= F.col("c.h"))).select("c.conv_id", F.col("t.place").alias("depth"), "a", "b", "words")
    moved = numbered.join(convs.select("conv_id", "h", "lent"), "conv_id").filter(F.col("place") > F.col("h")).select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "a", "b", "words")
    return inherited.unionByName(moved), convs.select("conv_id", (F.col("lent") + F.greatest(F.lit(0), F.col("turns") - F.col("h"))).alias("length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, words, k1, k2, p1, p2): the key of each prefix and
    of the one that is a turn shorter."""
    keyed = turns.select("conv_id", "depth", "words", F.xxhash64(F.lit(1), "depth", "a", "b").alias("x"), F.xxhash64(F.lit(2), "depth", "b", "a").alias("y"))
    run = running(keyed, "conv_id", [F.col("depth")], xors=["x", "y"])
    return run.select("conv_id", "depth", "words", F.col("run_x").alias("k1"), F.col("run_y").alias("k2"), F.col("run_x").bitwiseXOR(F.col("x")).alias("p1"), F.col("run_y").bitwiseXOR(F.col("y")).alias("p2"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) from (k1, k2, depth, conv_id): the digest
    of a sequence's ids, ascending, joined by commas."""
    keys = ["k1", "k2", "depth"]
    ranged = ends.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of up to CHUNK ids of one key; they break with a batch."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(c).to_numpy() for c in keys]
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            starts = np.flatnonzero(new)
            within = np.arange(n) - starts[np.cumsum(new) - 1]
            starts = np.flatnonzero(within % CHUNK == 0)
            ids = batch.column("conv_id").cast(pa.string()).to_pylist()
            stops = [*starts[1:].tolist(), n]
            texts = [",".join(ids[s:e]) for s, e in zip(starts.tolist(), stops, strict=True)]
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in [*keys, "conv_id"]], pa.array(texts, pa.string())], names=[*keys, "start", "ids"])

    kinds = ends.schema
    chunk = StructType([kinds[c] for c in keys]).add("start", LongType()).add("ids", StringType())
    chunks = ranged.mapInArrow(cut, chunk).repartition(*keys).sortWithinPartitions(*keys, "start")
    done = StructType([kinds[c] for c in keys]).add("ends_sha256", StringType())

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made: list[tuple] = []
            for a, b, d, text in zip(*[batch.column(c).to_pylist() for c in [*keys, "ids"]], strict=True):
                if (a, b, d) != key:
                    if key is not None:
                        made.append((*key, state.hexdigest()))
                    key, state = (a, b, d), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield table(made)
        if key is not None:
            yield table([(*key, state.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=done.names)

    return chunks.mapInArrow(read, done)


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    key = ["k1", "k2", "depth"]
    turns, convs = rebuilt(conversations)
    every = prefixes(turns)
    zero = F.lit(0).cast("long")
    # whole sequences, weighted; the least conversation of each stands for it
    whole = every.join(convs.filter("length > 0"), "conv_id").filter(F.col("depth") == F.col("length")).select("conv_id", *key)
    ends = materialize(whole.unionByName(convs.filter("length = 0").select("conv_id", zero.alias("k1"), zero.alias("k2"), zero.alias("depth"))))
    sequences = materialize(ends.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")))
    paths = materialize(every.join(sequences.select("conv_id", "weight"), "conv_id"))
    proper = paths.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).distinct()
    leaves = sequences.join(proper, key, "left_anti")
    nodes = materialize(paths.groupBy(*key).agg(F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.first("p1").alias("p1"), F.first("p2").alias("p2")))
    # what lies at or below each place of a sequence, deepest first
    value = (F.col("n_convs") - 1) * F.col("words")
    laid = paths.select("conv_id", "depth", F.lit(1).alias("kind"), "k1", "k2", zero.alias("saved"), zero.alias("leaf"))
    laid = laid.unionByName(nodes.select("conv_id", "depth", F.lit(0).alias("kind"), zero.alias("k1"), zero.alias("k2"), value.alias("saved"), zero.alias("leaf")))
    laid = laid.unionByName(leaves.filter("depth > 0").select("conv_id", "depth", F.lit(0).alias("kind"), zero.alias("k1"), zero.alias("k2"), zero.alias("saved"), F.lit(1).cast("long").alias("leaf")))
    below = running(laid, "conv_id", [F.col("depth").desc(), F.col("kind")], sums=["saved", "leaf"]).filter("kind = 1").groupBy(*key).agg(F.sum("run_saved").alias("saved_tokens"), F.sum("run_leaf").alias("n_leaves"))
    children = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    # the root: every conversation; its children need no join to find it
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    sums = nodes.agg(F.coalesce(F.sum(value), zero).alias("saved_tokens")).crossJoin(leaves.agg(F.count("*").alias("n_leaves")))
    top = root.crossJoin(sums).select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", zero.alias("k1"), zero.alias("k2"), "saved_tokens", "n_leaves")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    first = nodes.filter("depth = 1").crossJoin(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id"))))
    deeper = nodes.filter("depth > 1").join(parents, ["p1", "p2", "depth"])
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "k1", "k2"]
    inner = first.select(*names).unionByName(deeper.select(*names)).join(below, key)
    both = inner.unionByName(top).join(children, key, "left").join(end_digests(ends), key, "left")
    return both.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


ORACLE_SQL = r"""
WITH crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR)::BIGINT + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({'t': t, 'w': words} ORDER BY place) AS turns FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT l.conv_id, list_concat(coalesce(b.turns[1:h], []), l.turns[h + 1:]) AS seq
  FROM lists l JOIN crc USING (conv_id) LEFT JOIN lists b ON b.conv_id = l.conv_id - l.conv_id % 20),
prefixes AS (
  SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq)::BIGINT + 1)) AS depth, seq FROM rebuilt),
keyed AS (
  SELECT conv_id, n, depth, sha256(list_transform(seq[1:depth], lambda x: x.t)::VARCHAR) AS k, CASE WHEN depth > 0 THEN sha256(list_transform(seq[1:depth - 1], lambda x: x.t)::VARCHAR) END AS parent,
    CASE WHEN depth > 0 THEN seq[depth].w ELSE 0 END AS words FROM prefixes),
nodes AS (
  SELECT k, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM keyed GROUP BY k, depth),
children AS (SELECT parent AS k, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (SELECT DISTINCT a.k AS top, b.k AS k FROM keyed a JOIN keyed b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
below AS (
  SELECT top AS k, count(*) FILTER (WHERE c.k IS NULL) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM above JOIN nodes n USING (k) LEFT JOIN children c USING (k) GROUP BY top)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (k) LEFT JOIN children USING (k) LEFT JOIN nodes p ON p.k = n.parent"""
