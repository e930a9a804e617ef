"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words without punctuation at their ends,
the words' first 4 to 8 bytes (so an inflected insult is seen by its stem), and
the prefixes that two or three different words of the text share: one word
with an insult's stem may be chance, several are not. Each is hashed into
BUCKETS and counted once.

Training takes at most MAX_TRAIN labelled rows, those with the least hashed
ids. Every term that MIN_DOCS of them hold is a feature, whatever the labels
of those rows: a group's name that is as common in clean texts as in toxic
ones takes part, so the machine can learn that it and an insult together say
more than both weights. The machine sums a bias, a weight a feature and the
inner products of all feature pairs' factors. It is fitted twice on the
logistic loss. The first fit shrinks: weights by an amount that falls with
the term's own evidence, a feature's factors as a group. Features whose
weight and factors it leaves at nothing go, the others are fitted again with
little shrinkage. The settings were chosen on training rows alone (those of
one remainder of the id's checksum scored by a machine of the other's).

What the driver holds is bounded: MAX_TRAIN rows of hashed terms, at most
BUCKETS features. Scoring is one map with the machine broadcast.

Defined cases: a null or wordless text scores the bias; rows with a null id
are held out of training and scored; several labels of an id count as their
maximum, several texts of a labelled id as the one of the least hash; without
labels of both kinds every score is the share of toxic labels (0 without
any); repeated rows are scored each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquiro.llm.common import as_bytes, remainder_of_id, share, shared, text_slices

MAX_TRAIN, MIN_DOCS, BUCKETS = 12_000, 5, 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
LEVELS = (2, 3)  # different words of a text with one prefix
FACTORS, BATCH, RATE, FACTOR_RATE, START = 8, 64, 0.1, 0.05, 0.05
#: Of the two fits: row visits (and epochs at least), weight and factor penalty.
FITS = ((20_000, 3, 3e-3, 2e-2), (40_000, 3, 9e-4, 1e-3))
EVIDENCE, DROP = 15.0, 1e-2
THRESHOLD = 0.7
_ROWS = 256  # rows renamed at once
_EDGES = b".,;:!?\"'()[]{}<>%&$#*|-_/\\`~"


def word_term(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def prefix_term(prefix: bytes) -> int:
    return zlib.crc32(b"\0%d" % len(prefix) + prefix) % BUCKETS


def level_term(bucket: int, level: int) -> int:
    """The bucket that says: `level` different words share this prefix."""
    return zlib.crc32(b"\1%d,%d" % (level, bucket)) % BUCKETS


class Terms:
    """Buckets of a text's terms, mapped by `index` if one is given; holds
    the words and prefixes seen of late."""

    def __init__(self, index: dict[int, int] | None = None, most: int = 300_000):
        self.index, self.most = index, most
        self.words: dict[bytes, tuple] = {}
        self.levels: dict[int, tuple] = {}

    def _levels(self, bucket: int) -> tuple[tuple[int, int], ...]:
        """(level, feature) of a prefix that has some."""
        if bucket not in self.levels:
            made = ((k, level_term(bucket, k)) for k in LEVELS)
            self.levels[bucket] = tuple(made) if self.index is None else tuple((k, self.index[x]) for k, x in made if x in self.index)
        return self.levels[bucket]

    def _of_word(self, word: bytes) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The word's features, and its prefixes that have levels."""
        prefixes = [prefix_term(word[:k]) for k in PREFIXES if len(word) >= k]
        own = (word_term(word), *prefixes) if word else ()
        if self.index is not None:
            own = tuple(self.index[b] for b in own if b in self.index)
        return own, tuple(b for b in prefixes if self._levels(b))

    def __call__(self, text: bytes) -> set[int]:
        if len(self.words) > self.most or len(self.levels) > 4 * self.most:
            self.words, self.levels = {}, {}
        words = {w.strip(_EDGES) for w in set(text.lower().split())}
        for w in words:
            if w not in self.words:
                self.words[w] = self._of_word(w)
        mine = [self.words[w] for w in words]
        found = set(chain.from_iterable(x[0] for x in mine))
        for b, n in Counter(chain.from_iterable(x[1] for x in mine)).items():
            if n > 1:
                found.update(x for k, x in self._levels(b) if n >= k)
        return found


@dataclass
class Rows:
    """The features of several texts, one after the other."""

    flat: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, sets) -> Rows:
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        return cls(np.fromiter(chain.from_iterable(sets), dtype=np.int32, count=int(sizes.sum())), sizes)

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.sizes[rows]
        starts = (np.cumsum(self.sizes) - self.sizes)[rows]
        shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        return Rows(self.flat[shift + np.arange(len(shift))], sizes)

    def renamed(self, to: np.ndarray) -> Rows:
        """With feature i called to[i]; those below zero go."""
        to, flat, sizes = to.astype(np.int32), np.empty(len(self.flat), dtype=np.int32), np.zeros(len(self.sizes), dtype=np.int64)
        at = done = 0
        for low in range(0, len(sizes), _ROWS):
            own = self.sizes[low : low + _ROWS]
            new = to[self.flat[at : at + int(own.sum())]]
            kept = new >= 0
            sizes[low : low + _ROWS] = np.bincount(np.repeat(np.arange(len(own)), own)[kept], minlength=len(own))
            at, new = at + len(new), new[kept]
            flat[done : done + len(new)] = new
            done += len(new)
        return Rows(flat[:done], sizes)

    def counts(self, n: int) -> np.ndarray:
        """In how many texts each of n features is; part by part, as numpy
        counts on a copy of 64 bits each."""
        out, step = np.zeros(n, dtype=np.int64), 1 << 20
        for low in range(0, len(self.flat), step):
            out += np.bincount(self.flat[low : low + step], minlength=n)
        return out


@dataclass
class FactorizationMachine:
    index: dict[int, int]  # bucket to feature
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, rows: Rows) -> np.ndarray:
        """Of each text: bias, weights and pairs."""
        n = len(rows.sizes)
        row = np.repeat(np.arange(n), rows.sizes)
        out = self.bias + np.bincount(row, self.weights[rows.flat], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[rows.flat, f]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out

    def score(self, sets: list[set[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(Rows.of(sets)), -30, 30)))


def evidence(rows: Rows, toxic: np.ndarray, n_features: int) -> np.ndarray:
    """Log likelihood ratio of each feature and the labels."""
    d = rows.counts(n_features).astype(float)
    t = rows.take(np.flatnonzero(toxic)).counts(n_features).astype(float)
    n, pos = float(len(toxic)), float(toxic.sum())

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    base = pos / n
    return 2 * (part(t, d * base) + part(d - t, d * (1 - base)) + part(pos - t, (n - d) * base) + part(n - d - pos + t, (n - d) * (1 - base)))


def _descend(rows: Rows, toxic: np.ndarray, penalties: np.ndarray, group: float, epochs: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by AdaGrad steps, each followed by a shrink
    of the weights (one by one) and of the factors (a feature at a time)."""
    rng, n = np.random.default_rng(seed), len(penalties)
    base = toxic.mean()
    bias, w, v = math.log(base / (1 - base)), np.zeros(n), rng.normal(0, START / math.sqrt(FACTORS), (n, FACTORS))
    square_b, square_w, square_v = 1e-6, np.full(n, 1e-4), np.full(n, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(toxic))
        for low in range(0, len(order), BATCH):
            part = order[low : low + BATCH]
            batch, k = rows.take(part), len(part)
            used, at = np.unique(batch.flat, return_inverse=True)
            row = np.repeat(np.arange(k), batch.sizes)
            old = v[used]
            z, sums = bias + np.bincount(row, w[used][at], k), np.empty((k, FACTORS))
            for f in range(FACTORS):
                x = old[at, f]
                sums[:, f] = np.bincount(row, x, k)
                z += 0.5 * (sums[:, f] ** 2 - np.bincount(row, x * x, k))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[part]) / k
            square_b += g.sum() ** 2
            bias -= RATE * g.sum() / math.sqrt(square_b)
            each = g[row]
            gw = np.bincount(at, each, len(used))
            square_w[used] += gw * gw
            step = RATE / np.sqrt(square_w[used])
            new = w[used] - step * gw
            w[used] = np.sign(new) * np.maximum(np.abs(new) - step * penalties[used], 0)
            gv = np.stack([np.bincount(at, each * sums[row, f], len(used)) for f in range(FACTORS)], axis=1) - gw[:, None] * old
            square_v[used] += (gv * gv).sum(axis=1)
            step = FACTOR_RATE / np.sqrt(square_v[used])
            new = old - step[:, None] * gv
            norm = np.sqrt((new * new).sum(axis=1)) + 1e-12
            v[used] = new * np.maximum(0, 1 - step * group / norm)[:, None]
    return bias, w, v


def fit_machine(rows: Rows, buckets: np.ndarray, toxic: np.ndarray, seed: int = 5) -> FactorizationMachine:
    """The machine of rows whose feature i stands for buckets[i]."""
    base = float(toxic.mean()) if len(toxic) else 0.0
    bias, w, v = float(np.clip(np.log((base + 1e-9) / (1 - base + 1e-9)), -30, 30)), np.zeros(0), np.zeros((0, FACTORS))
    if not 0 < base < 1 or not len(buckets):
        return FactorizationMachine({}, bias, w, v)
    ease = np.clip(EVIDENCE / np.maximum(evidence(rows, toxic, len(buckets)), 1e-3), 0.05, 10)
    for visits, least, penalty, group in FITS:
        bias, w, v = _descend(rows, toxic, penalty * ease, group, max(least, math.ceil(visits / len(toxic))), seed)
        kept = (w != 0) | (np.abs(v).max(axis=1) > DROP)
        to = np.where(kept, np.cumsum(kept) - 1, -1)
        rows, buckets, ease, w, v = rows.renamed(to), buckets[kept], ease[kept], w[kept], v[kept]
        if not len(buckets):
            break
    return FactorizationMachine({b: i for i, b in enumerate(buckets.tolist())}, bias, w, v)


def train(docs: DataFrame, labels: DataFrame, *, divisor: int = 3, held_out: int = 1, max_train: int = MAX_TRAIN) -> FactorizationMachine:
    """Learn from the labelled rows outside the held-out remainder."""
    usable = labels.filter(F.col("toxic").isNotNull() & (remainder_of_id(F.col("doc_id"), divisor) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # at most max_train ids
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = texts.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    wanted = one.select(F.xxhash64("doc_id", "t.h").alias("place"), "toxic", F.col("t.text").alias("text"))

    def read(batches):
        terms = Terms()
        for batch in text_slices(batches):
            found = [sorted(terms(t)) for t in as_bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["place", "toxic", "terms"])

    held = wanted.mapInArrow(read, "place long, toxic double, terms array<int>").toArrow().sort_by("place").combine_chunks()
    if not held.num_rows:
        return fit_machine(Rows.of([]), np.zeros(0, dtype=np.int64), np.zeros(0))
    lists = held.column("terms").combine_chunks()
    toxic = held.column("toxic").to_numpy()
    rows = Rows(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64))
    common = rows.counts(BUCKETS) >= MIN_DOCS
    rows = rows.renamed(np.where(common, np.cumsum(common) - 1, -1))
    del held, lists  # all rare terms are still in them
    pa.default_memory_pool().release_unused()
    return fit_machine(rows, np.flatnonzero(common), toxic)


def score_documents(docs: DataFrame, labels: DataFrame, *, divisor: int = 3, held_out: int = 1, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score, predicted."""
    model = share(docs.sparkSession, train(docs, labels, divisor=divisor, held_out=held_out, max_train=max_train))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        machine = shared(model)
        terms = Terms(machine.index)
        for batch in text_slices(batches):
            s = machine.score([terms(t) for t in as_bytes(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(remainder_of_id(F.col("doc_id"), divisor) == held_out, F.lit(True))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    model = share(docs.sparkSession, train(docs, labels))

    def keep(batches):
        machine = shared(model)
        terms = Terms(machine.index)
        for batch in text_slices(batches):
            yield batch.filter(pa.array(machine.score([terms(t) for t in as_bytes(batch)]) < threshold))

    return docs.mapInArrow(keep, docs.schema)
