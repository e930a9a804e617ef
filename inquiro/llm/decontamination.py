"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit check.

Texts become lower-cased words without ASCII punctuation. The walk of
Chakraborty, Goldenberg and Koucky reads a word sequence with a pointer: at
step j it emits the word under the pointer and moves on if a random bit of
(j, word) says so, so sequences at a small edit distance walk in step again
after an edit and their walks differ in few places. Windows are item-sized: an
item of n words is looked up by windows of n words. One of more than WINDOW
words is cut into p nearly equal pieces of at most WINDOW; of the k edits
that the radius allows, some piece has at most k / p. Each repetition walks
with coins of its own and samples SAMPLED coordinates of the walk; a document
window that agrees on them with an item's is a candidate. The number of
repetitions of each window size comes from TARGET: it is the least at which
simulated copies with that size's allowance of random edits are found that
often, an edit being a replaced, added or lost word (see repeats_for). As a
copy may also have lost its first words at once, an item's windows are listed
again without as many of their first words as half or all of the edits.
Every candidate is checked exactly: the least edit distance between the item
and any stretch of the document around the window, in words, must be at most
`radius` of the item's length.

Windows start at every word, but a start is walked only if what follows can
hold a match at all: k edits leave n - 1 - 2k of an item's word pairs whole,
so that many pairs known from the benchmark must lie within n + k words (or,
where that number is not positive, n - k known words). That test loses nothing.

The benchmark is read in chunks of CHUNK items or CHUNK_BYTES of text, each
broadcast; where there are several, each pass over the documents is written
before the next and its broadcast destroyed, so one chunk is held at a time
and time grows with the number of chunks. Documents are never shuffled. A
task holds slices of about 4 MB.

Defined cases: null or wordless texts and items match nothing; null ids and
repeated rows or items are reported like others; an empty table gives no
rows; other columns are not read by the report and stay in drop_leaks().
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from inquiro.llm.common import arrow_type, as_bytes, materialize, share, shared, text_slices

WINDOW, SAMPLED, STEPS_A_WORD, TARGET, MAX_REPEATS, RADIUS, CHUNK, CHUNK_BYTES = 64, 2, 1.4, 0.98, 64, 0.2, 20_000, 16 << 20
_PAD = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 15  # starts walked at once
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return h


def steps_of(size: int) -> int:
    return max(SAMPLED, round(STEPS_A_WORD * size))


def pointers(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, repeat: int) -> np.ndarray:
    """(steps, starts): how far each walk of one repetition has come. Past
    its end a walk stands on words[ends]."""
    coins = words * (np.random.default_rng(repeat).integers(1, 1 << 62, dtype=np.uint64) | np.uint64(1))
    coins ^= coins >> np.uint64(29)
    out, at = np.zeros((steps, len(starts)), dtype=np.int32), starts.copy()
    for j in range(steps):
        out[j] = at - starts
        moves = coins[at] * np.uint64((2 * j + 1) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> np.uint64(63)
        at = np.minimum(at + moves.astype(np.int64), ends)
    return out


def window_keys(words: np.ndarray, starts: np.ndarray, walked: np.ndarray, size: int, repeat: int, own: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The key of the window of `size` words at each of the starts `own` in
    one repetition."""
    starts = starts[own]
    rng = np.random.default_rng((size, repeat))
    key = np.full(len(starts), np.uint64(size << 8 | repeat))
    for j in sorted(rng.choice(steps_of(size), SAMPLED, replace=False).tolist()):
        far = walked[j][own]
        said = np.where(far < size, words[starts + far], _PAD)
        key = (key ^ said) * (rng.integers(1, 1 << 62, dtype=np.uint64) | np.uint64(1))
        key ^= key >> np.uint64(31)
    return key


def edited(words: list, edits: int, rng: np.random.Generator, fresh) -> list:
    """A copy with random words replaced, added or lost, one an edit."""
    out = list(words)
    for kind, at in zip(rng.integers(0, 3, edits), rng.random(edits)):
        k = int(at * len(out))
        out[k : k + (kind != 1)] = [] if kind == 2 and len(out) > 1 else [fresh()]
    return out


@lru_cache(maxsize=None)
def repeats_for(size: int, edits: int, target: float, copies: int = 200) -> int:
    """Repetitions that find `target` of simulated copies of windows of
    `size` different words after `edits` random edits, MAX_REPEATS at most."""
    if not edits:
        return 1
    rng, new = np.random.default_rng(size), count(1)
    fresh = lambda: next(new) * int(_SPREAD) >> 1 & (1 << 62) - 1
    pairs, width = [], 2 * size + 2
    for _ in range(copies):
        item = [fresh() for _ in range(size)]
        pairs += [item, (edited(item, edits, rng, fresh) + [fresh() for _ in range(size)])[:size]]
    words = np.full((len(pairs), width), _PAD)
    for row, p in zip(words, pairs):
        row[: len(p)] = p
    starts = np.arange(len(pairs)) * width
    found = np.zeros(copies, dtype=bool)
    for r in range(MAX_REPEATS):
        keys = window_keys(words.ravel(), starts, pointers(words.ravel(), starts, starts + width - 1, steps_of(size), r), size, r)
        found |= keys[::2] == keys[1::2]
        if found.mean() >= target:
            return r + 1
    return MAX_REPEATS


def nearest_distance(item: list[bytes], text: list[bytes], masks: dict[bytes, int]) -> int:
    """Least edit distance, in words, between item and any stretch of text
    (Myers' bit vectors in one Python integer). masks: bit i of masks[w] says
    item[i] == w."""
    top = 1 << len(item) - 1
    full = (top << 1) - 1
    plus, minus, now, best = full, 0, len(item), len(item)
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
            if now < best:
                best = now
        ph, mh = ph << 1, mh << 1
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv & full
    return best


class KnownKeys:
    """Which hashes are among the given ones: flags of 16 places a hash, then
    a search of the sorted hashes."""

    def __init__(self, keys: list[int]):
        bits = max(12, (16 * len(keys)).bit_length())
        self.keys = np.unique(np.array(keys, dtype=np.uint64))
        self.shift, self.flags = np.uint64(64 - bits), np.zeros(1 << bits, dtype=bool)
        self.flags[self.keys * _SPREAD >> self.shift] = True

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        return self.flags[keys * _SPREAD >> self.shift]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Places of the known ones."""
        at = np.flatnonzero(self.maybe(keys))
        near = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        return at[self.keys[near] == keys[at]]


def word_pairs(words: np.ndarray) -> np.ndarray:
    return words[:-1] * _SPREAD + words[1:]


class Items:
    """A chunk of the benchmark with the hash table of its windows."""

    def __init__(self, ids: list, texts: list[bytes], radius: float = RADIUS, target: float = TARGET):
        self.ids, self.radius = ids, radius
        self.words = [plain_words(t) for t in texts]
        self.bags = [Counter(w) for w in self.words]
        hashes, windows = WordHashes(), defaultdict(list)
        self.edits: dict[int, int] = {}  # most edits of a window, by its size
        singles, pairs = set(), set()
        for i, words in enumerate(self.words):
            if not words:
                continue
            h = np.array([hashes[w] for w in words], dtype=np.uint64)
            singles.update(h.tolist())
            pairs.update(word_pairs(h).tolist())
            parts = -(-len(words) // WINDOW)
            most = int(radius * len(words)) // parts
            cuts = [len(words) * p // parts for p in range(parts + 1)]
            for low, high in zip(cuts, cuts[1:]):
                windows[high - low].append((i, low, h[low:high]))
                self.edits[high - low] = max(most, self.edits.get(high - low, 0))
        self.repeats = {n: repeats_for(n, k, target) for n, k in self.edits.items()}
        self.table: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, listed in windows.items():
            flat = np.concatenate([x for _, _, h in listed for x in (h, [_PAD])]).astype(np.uint64)
            for lost in {0, self.edits[n] // 2, self.edits[n]}:
                begin = np.arange(len(listed)) * (n + 1)
                starts, ends = begin + lost, begin + n
                for r in range(self.repeats[n]):
                    keys = window_keys(flat, starts, pointers(flat, starts, ends, steps_of(n), r), n, r)
                    for key, (i, low, _) in zip(keys.tolist(), listed):
                        self.table[key].append((i, low + lost))
        self.table = dict(self.table)
        self.known, self.known_words, self.known_pairs = KnownKeys(list(self.table)), KnownKeys(list(singles)), KnownKeys(list(pairs))
        self.masks: dict[int, dict[bytes, int]] = {}

    def mask(self, i: int) -> dict[bytes, int]:
        if i not in self.masks:
            m: dict[bytes, int] = defaultdict(int)
            for at, w in enumerate(self.words[i]):
                m[w] |= 1 << at
            self.masks[i] = dict(m)
        return self.masks[i]

    def possible(self, flat: np.ndarray) -> dict[int, np.ndarray]:
        """By window size, the starts that may begin a match."""
        real = flat != _PAD
        widest = np.zeros(max((n + k for n, k in self.edits.items()), default=0), dtype=bool)
        single = np.cumsum(np.concatenate([[False], self.known_words.maybe(flat) & real, widest]), dtype=np.int32)
        pair = np.cumsum(np.concatenate([[False], self.known_pairs.maybe(word_pairs(flat)) & real[:-1] & real[1:], widest]), dtype=np.int32)
        out = {}
        for n, k in self.edits.items():
            need = n - 1 - 2 * k
            sums, need, width = (pair, need, n + k - 1) if need > 0 else (single, n - k, n + k)
            out[n] = np.flatnonzero(sums[width:] - sums[:-width] >= need)
        return out

    def candidates(self, flat: np.ndarray, ends: np.ndarray):
        """Yields (start, item, place of the window in the item)."""
        possible = self.possible(flat)
        every = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *possible.values()]))
        for low in range(0, len(every), _BLOCK):
            starts = every[low : low + _BLOCK]
            stops = ends[np.searchsorted(ends, starts)]
            own = {n: at for n, s in possible.items() if len(at := np.flatnonzero(np.isin(starts, s, assume_unique=True)))}
            for r in range(max((self.repeats[n] for n in own), default=0)):
                sizes = [n for n in own if self.repeats[n] > r]
                walked = pointers(flat, starts, stops, steps_of(max(sizes)), r)
                for n in sizes:
                    keys = window_keys(flat, starts, walked, n, r, own[n])
                    for at in self.known.places(keys).tolist():
                        for i, offset in self.table[int(keys[at])]:
                            yield int(starts[own[n][at]]), i, offset

    def matches(self, texts: list[bytes], hashes: WordHashes) -> list[dict[int, int]]:
        """Per text: items within the radius, with their edit distance."""
        words = [plain_words(t) for t in texts]
        sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        ends = np.cumsum(sizes) - 1  # each text's padding word
        flat = np.full(int(sizes.sum()), _PAD)
        for end, w in zip(ends.tolist(), words):
            flat[end - len(w) : end] = np.fromiter(map(hashes.__getitem__, w), dtype=np.uint64, count=len(w))
        firsts: dict[tuple[int, int], set[int]] = defaultdict(set)
        for start, i, offset in self.candidates(flat, ends):
            d = int(np.searchsorted(ends, start))
            firsts[d, i].add(start - int(ends[d]) + len(words[d]) - offset)
        found: list[dict[int, int]] = [{} for _ in texts]
        seen: dict[tuple[int, bytes], int] = {}
        for (d, i), places in firsts.items():
            away = min(self._distance(i, words[d][low:high], seen) for low, high in self._regions(i, sorted(places)))
            if away <= int(self.radius * len(self.words[i])):
                found[d][i] = away
        return found

    def _regions(self, i: int, firsts: list[int]) -> list[tuple[int, int]]:
        """Stretches around the places where the item may begin, merged."""
        n, out = len(self.words[i]), []
        spare = int(self.radius * n) + 1
        for first in firsts:
            # a window is found a few words beside its place at times
            low, high = max(0, first - 2 * spare), max(0, first + n + 2 * spare)
            if out and low <= out[-1][1]:
                out[-1] = out[-1][0], high
            else:
                out.append((low, high))
        return out

    def _distance(self, i: int, region: list[bytes], seen: dict) -> int:
        key = i, b" ".join(region)
        if key not in seen:
            n, there = len(self.words[i]), Counter(region)
            # each edit takes at most one of the item's words away
            common = sum(min(k, there[w]) for w, k in self.bags[i].items())
            seen[key] = nearest_distance(self.words[i], region, self.mask(i)) if common >= n - int(self.radius * n) else n
        return seen[key]


def _chunks(benchmark: DataFrame, chunk: int):
    """Chunks of at most `chunk` items, collected one at a time."""
    ids, texts, held = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append((row.text or "").encode())
        held += len(texts[-1])
        if len(ids) == chunk or held >= CHUNK_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _passes(docs: DataFrame, benchmark: DataFrame, chunk: int, radius: float, read):
    """read(docs or what the last pass gave, broadcast) of each chunk; all
    but the last are written, and their broadcasts destroyed."""
    before = None
    for ids_texts in _chunks(benchmark, chunk):
        if before is not None:
            out, sent = before
            written = materialize(out)
            sent.destroy()
            yield written
        sent = share(docs.sparkSession, Items(*ids_texts, radius=radius))
        before = read(sent), sent
    if before is not None:
        yield before[0]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, radius: float = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, item_id, distance, similarity): each row of docs and each
    item that it holds; distance in words."""
    kinds = [docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType]
    item_type = arrow_type(kinds[1])
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, distance long, similarity double"

    def read(sent):
        def search(batches):
            items, hashes = shared(sent), WordHashes()
            for batch in text_slices(batches):
                found = [(d, items.ids[i], away, 1 - away / len(items.words[i])) for d, of in enumerate(items.matches(as_bytes(batch), hashes)) for i, away in sorted(of.items())]
                d, ids, away, like = zip(*found) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d, pa.int64())), pa.array(ids, item_type), pa.array(away, pa.int64()), pa.array(like, pa.float64())], names=["doc_id", "item_id", "distance", "similarity"])

        return docs.select("doc_id", "text").mapInArrow(search, schema)

    out = None
    for part in _passes(docs, benchmark, chunk, radius, read):
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, radius: float = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    left = docs

    def read(sent):
        def keep(batches):
            items, hashes = shared(sent), WordHashes()
            for batch in text_slices(batches):
                yield batch.filter(pa.array([not f for f in items.matches(as_bytes(batch), hashes)], pa.bool_()))

        return left.mapInArrow(keep, docs.schema)

    for part in _passes(docs, benchmark, chunk, radius, read):
        left = part
    return left
