"""LM scoring with a probabilistic suffix tree over the words of a corpus.

The tree's alphabet is bounded: the SYMBOLS most frequent words, the end of a
text, and a class for all other words that share their last two bytes. A
context becomes a state when it is common enough and its next-symbol
distribution diverges from that of its suffix; a state's distribution is
absolute-discounted onto its suffix state's, down to the root's, which covers
the whole alphabet. A token is scored in the longest suffix of its context
that is a state; a word of a class then costs its add-one share of that
class, so that all unseen words of a class are one event, as they are in the
unigram base.

Contexts are of two kinds.
  Of up to `depth` symbols: the frequent ones, above `min_share` of all
  tokens. There are at most 1 / min_share a level and 4 / min_share listed
  symbols whatever the input's size; they are what is broadcast.
  Of DEEP words: every context that occurs `min_deep` times or more, so what
  the model holds grows with the corpus. Those that repeat are found first:
  32 bits of their hashes are grouped by parts of about PART contexts (one
  that passes wrongly is caught in the counts), then they are counted with
  their followers. They are never gathered: counts, divergence and smoothing are joins over hashed contexts (64 bits). The
  suffix of such a state is the longest of the first kind. In it a word of
  the HEAD most frequent is its own symbol, any other its class. Texts meet
  their states in a join, of which a table of 2^BLOOM flags, of fixed size,
  spares (as in the counting) the tokens that cannot have one; where the flags are full, all
  tokens take part. Contexts with over 1 / HOT of all tokens, of which there
  are at most HOT, are dealt over SALTS keys in that join.

Texts are split into words twice, once to count words and once to write each
as a row of codes; all else reads the codes. Counts cover all training rows.
The vocabulary has no bound: the HEAD most frequent words are broadcast, all
other words of a text meet their counts in a shuffled join.

Defined cases: a null text is empty (its only token is the end); a null id
belongs to the training rows; repeated rows count and score each; an empty
table gives no rows; with no training rows every count is zero and the root
is uniform. Other columns of the input are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inquiro.llm.common import as_bytes, materialize, own_shuffles, remainder_of_id, share, shared, text_slices

DEPTH = 2
MIN_SHARE = 2e-5
DIVERGENCE = 12.0
DISCOUNT = 0.75
SYMBOLS = 4096
CLASSES = 1024
HEAD = 1 << 17
BITS = 13  # of a symbol's id
DEEP, MIN_DEEP, BLOOM, WORD_BLOOM, HOT, SALTS, PART = 4, 2, 28, 26, 20_000, 16, 500_000
RARE = 20  # bits of a rare word's hash in its code
_ONCE = (1 << RARE) - 1  # in place of that hash: the word occurs once or never
END = b"\n"
_EMPTY = np.int64(-1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all words and the end tokens of the training texts."""

    def count(batches):
        for batch in text_slices(batches, limit=8 << 20):
            seen: Counter = Counter()
            for t in as_bytes(batch):
                seen.update(t.lower().split())
            seen[END] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    return training.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Alphabet:
    """Symbols 0 to n_words - 1 are words, the next the classes, then the
    class of all other words; `counts` has a symbol's tokens, `kinds` the
    distinct words of a class."""

    head: dict[bytes, int]  # the HEAD words: place in head_symbol and head_log
    head_symbol: np.ndarray
    head_log: np.ndarray  # log10(c + 1)
    classes: dict[bytes, int]
    other: int
    counts: np.ndarray
    kinds: np.ndarray
    n_words: int
    repeated: bytes = b"\0" * (1 << WORD_BLOOM - 3)  # flags of words that occur twice or more

    def read(self, words: list[bytes]) -> tuple[list[int], list[bytes]]:
        """Codes of the words and the end, and the words outside the head. A
        head word's code is its place; others' are below zero and hold their
        class and RARE bits of their hash."""
        head, classes, other, repeated = self.head, self.classes, self.other, self.repeated
        codes, rare = [], []
        for w in words:
            k = head.get(w)
            if k is None:
                h = zlib.crc32(w) >> 32 - WORD_BLOOM
                h = h % _ONCE if repeated[h >> 3] >> (h & 7) & 1 else _ONCE
                k = -1 - (classes.get(w[-2:], other) - self.n_words << RARE | h)
                rare.append(w)
            codes.append(k)
        codes.append(head[END])
        return codes, rare

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes >= 0, self.head_symbol[np.maximum(codes, 0)], self.n_words + (-1 - codes >> RARE))


def read_codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all texts, their numbers)."""
    column = batch.column("codes")
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), dtype="<i4").astype(np.int64), np.array([len(x) // 4 for x in blobs], dtype=np.int64)


def encode(docs: DataFrame, alphabet: Broadcast) -> DataFrame:
    """docs(doc_id, text, held_out) with codes and rare (word, times) in place
    of the text, and a number for each row."""

    def run(batches):
        letters = shared(alphabet)
        for batch in text_slices(batches, limit=2 << 20):
            blobs, rare = [], []
            for t in as_bytes(batch):
                codes, out = letters.read(t.lower().split())
                blobs.append(np.array(codes, dtype="<i4").tobytes())
                rare.append([{"word": w, "times": k} for w, k in Counter(out).items()])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "held_out")), pa.array(blobs, pa.binary()), pa.array(rare, rare_type)], names=["doc_id", "held_out", "codes", "rare"])

    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, codes binary, rare array<struct<word:binary,times:long>>")
    return coded.withColumn("row", F.monotonically_increasing_id())  # kept, once written


def build_alphabet(counts: DataFrame, symbols: int = SYMBOLS, classes: int = CLASSES, head: int = HEAD) -> Alphabet:
    order = [F.desc("c"), F.asc("word")]
    top = counts.orderBy(*order).limit(head).toArrow()
    words, c = top.column("word").to_pylist(), np.array(top.column("c").to_pylist(), dtype=np.int64)
    if END in words[:symbols]:
        own = words[:symbols]
    else:
        own = [*words[: symbols - 1], END]
    if END not in words:
        words, c = [*words, END], np.append(c, (counts.filter(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0))
    in_own = {w: i for i, w in enumerate(own)}
    last_c, last = (int(c[words.index(own[-1])]), own[-1]) if own[-1] != END else (int(c[max(0, len(own) - 2)]), words[max(0, len(own) - 2)])
    rest = counts.filter(((F.col("c") < last_c) | ((F.col("c") == last_c) & (F.col("word") > F.lit(last)))) & (F.col("word") != F.lit(END)))
    by_class = rest.groupBy(F.expr("substring(word, -2, 2)").alias("tail")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    all_c, all_v = rest.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    kept = by_class.orderBy(F.desc("c"), "tail").limit(classes).toArrow()
    names, cc, cv = (kept.column(k).to_pylist() for k in ("tail", "c", "v"))
    n = len(own)
    index = {t: n + i for i, t in enumerate(names)}
    other = n + len(names)
    place = {w: i for i, w in enumerate(words)}
    head_symbol = np.array([in_own[w] if w in in_own else index.get(w[-2:], other) for w in words], dtype=np.int64)
    total = np.concatenate([[c[place[w]] for w in own], cc, [all_c - sum(cc)]]).astype(float)
    kinds = np.concatenate([np.zeros(n), cv, [all_v - sum(cv)]])
    twice = counts.filter("c > 1").select(F.shiftrightunsigned(F.crc32("word"), 32 - WORD_BLOOM).alias("place"))
    return Alphabet(place, head_symbol, np.log10(c + 1.0), index, other, total, kinds, n, flag_table(twice, WORD_BLOOM).tobytes())


def flag_table(places: DataFrame, bits: int) -> np.ndarray:
    """2^bits flags, packed in 64-bit words, set at the given places."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    return flags_of(places.select(F.shiftright("place", 6).alias("w"), one.alias("v")), bits)


def flags_of(words: DataFrame, bits: int) -> np.ndarray:
    """2^bits flags from words(w, v) of 64 flags each."""
    with own_shuffles(words.sparkSession):
        words = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # at most 2^bits / 64 rows
    flags = np.zeros(1 << bits - 6, dtype=np.int64)
    flags[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return flags.view(np.uint64)


def context_codes(symbols: np.ndarray, starts: np.ndarray, end: int, order: int) -> np.ndarray:
    """Per token its symbol below the `order` symbols before it; the end
    symbol pads the contexts at a text's start."""
    codes = symbols.copy()
    for back in range(1, order + 1):
        before = np.roll(symbols, back)
        for j in range(back):
            inside = starts + j < len(symbols)
            before[(starts + j)[inside]] = end
        codes |= before << (BITS * back)
    return codes


class Table:
    """Open-addressed numpy table from codes to numbers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(4 * len(keys) + 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.zeros(1 << bits)
        slots = (keys.astype(np.uint64) * _SPREAD >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] == _EMPTY]
            won = free[np.unique(slots[free], return_index=True)[1]]
            self.keys[slots[won]], self.values[slots[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slots[left] = (slots[left] + 1) & ((1 << bits) - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is there, its value or 0) of each key."""
        slots = (keys.view(np.uint64) * _SPREAD >> self.shift).astype(np.int64)
        there = self.keys[slots]
        hit = there == keys
        left = np.flatnonzero(~hit & (there != _EMPTY))
        while len(left):
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[left]]
            hit[left] = there == keys[left]
            left = left[(there != keys[left]) & (there != _EMPTY)]
        return hit, np.where(hit, self.values[slots], 0.0)


def follower_counts(training: DataFrame, alphabet, contexts, order: int) -> DataFrame:
    """(code, n): how often each symbol follows each of the given contexts
    of `order` symbols, over all training texts."""

    def count(batches):
        letters, frequent = shared(alphabet), shared(contexts)
        end = int(letters.head_symbol[letters.head[END]])
        for batch in text_slices(batches, column="codes", limit=8 << 20):
            flat, sizes = read_codes(batch)
            codes = context_codes(letters.symbols(flat), np.cumsum(sizes) - sizes, end, order)
            codes, n = np.unique(codes[frequent.find(codes >> BITS)[0]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

    return training.select("codes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class State:
    symbols: np.ndarray  # listed, ascending
    p: np.ndarray  # smoothed probability of each
    rest: float  # weight of the suffix state for all others
    suffix: tuple[int, int]


class SuffixTree:
    """States by (order, context); the root lists every symbol."""

    def __init__(self, root: np.ndarray, depth: int):
        self.depth = depth
        self.states = {(0, 0): State(np.arange(len(root)), root, 0.0, (0, 0))}
        self.table: Table | None = None

    def suffix_of(self, order: int, context: int) -> tuple[int, int]:
        k = order - 1
        while (k, context & ((1 << BITS * k) - 1)) not in self.states:
            k -= 1
        return k, context & ((1 << BITS * k) - 1)

    def probability(self, key: tuple[int, int], symbols: np.ndarray) -> np.ndarray:
        state = self.states[key]
        if key == (0, 0):
            return state.p[symbols]
        at = np.minimum(np.searchsorted(state.symbols, symbols), len(state.symbols) - 1)
        return np.where(state.symbols[at] == symbols, state.p[at], state.rest * self.probability(state.suffix, symbols))

    def add(self, order: int, context: int, symbols: np.ndarray, n: np.ndarray, total: int, discount: float) -> None:
        key = self.suffix_of(order, context)
        taken = np.maximum(n - discount, 0) / total
        rest = 1.0 - float(taken.sum())
        self.states[order, context] = State(symbols, taken + rest * self.probability(key, symbols), rest, key)

    def freeze(self) -> None:
        """The table from which tokens are scored: entries (state and
        symbol) and, apart by a high bit, the states themselves."""
        keys, values = [], []
        for (order, context), s in self.states.items():
            keys.append((np.int64(context) << BITS | s.symbols) | np.int64(order + 1) << 56)
            values.append(np.log10(s.p))
            if order:
                keys.append(np.array([np.int64(context) | np.int64(order + 17) << 56]))
                values.append(np.array([math.log10(max(s.rest, 1e-12))]))
        self.table, self.states = Table(np.concatenate(keys), np.concatenate(values)), {}

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each token's symbol in its longest state."""
        out, at = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(self.depth, -1, -1):
            hit, value = self.table.find(codes & np.int64((1 << BITS * (order + 1)) - 1) | np.int64(order + 1) << 56)
            out[at] += value
            at, codes = at[~hit], codes[~hit]
            if not len(at):
                break
            out[at] += self.table.find(codes >> BITS & np.int64((1 << BITS * order) - 1) | np.int64(order + 17) << 56)[1]
        return out


def build_tree(training: DataFrame, alphabet: Alphabet, broadcast, *, depth: int, min_share: float, divergence: float, discount: float) -> SuffixTree:
    """Grow the tree level by level.

    A frequent context of n occurrences stays if its log likelihood ratio
    n * KL(context || suffix state) reaches `divergence` nats.
    """
    spark = training.sparkSession
    total = float(alphabet.counts.sum())
    tree = SuffixTree((alphabet.counts + 0.5) / (total + 0.5 * len(alphabet.counts)), depth)
    least = max(2.0, min_share * total)
    end = int(alphabet.head_symbol[alphabet.head[END]])
    frequent = np.flatnonzero(alphabet.counts >= least).astype(np.int64)
    for order in range(1, depth + 1):
        if not len(frequent):
            break
        contexts = share(spark, Table(frequent, np.zeros(len(frequent))))
        grams = follower_counts(training, broadcast, contexts, order)
        symbol = F.col("code").bitwiseAND(F.lit((1 << BITS) - 1))
        rows = (
            grams.groupBy(F.shiftrightunsigned("code", BITS).alias("context"))
            .agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.when(F.col("n") >= least / 4, F.struct(symbol.alias("s"), "n")))).alias("listed"))
            .select("context", "total", F.col("listed.s").alias("s"), F.col("listed.n").alias("n"))
            .toArrow()
        )
        heavy = []
        for context, all_, s, n in sorted(zip(*(rows.column(k).to_pylist() for k in ("context", "total", "s", "n")))):
            if not s:
                continue
            symbols, times = np.array(s, dtype=np.int64), np.array(n, dtype=float)
            q, below = times / all_, tree.probability(tree.suffix_of(order, context), symbols)
            gone, there = 1 - q.sum(), 1 - below.sum()
            gain = all_ * (float((q * np.log(q / below)).sum()) + (gone * math.log(gone / there) if gone > 1e-9 and there > 1e-12 else 0.0))
            if gain >= divergence:
                tree.add(order, context, symbols, times, all_, discount)
            heavy.append(np.int64(context) << BITS | symbols[(times >= least) & (symbols != end)])
        first = [np.array([(1 << BITS * (order + 1)) - 1 & sum(end << BITS * k for k in range(order + 1))], dtype=np.int64)]
        frequent = np.unique(np.concatenate(first + heavy))
    tree.freeze()
    return tree


class Scorer:
    """log10 probabilities of tokens under the first kind of states."""

    def __init__(self, letters: Alphabet, tree: SuffixTree):
        self.letters, self.tree = letters, tree
        self.end = int(letters.head_symbol[letters.head[END]])
        self.in_class = -np.log10(letters.counts + letters.kinds + 1)
        self.in_class[: letters.n_words] = 0

    def __call__(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(of the symbol in the deep sense: a head word, else a class; what a
        word then costs within its class, but for a rare word's own count)."""
        of = self.letters.symbols(codes)
        log_p = self.tree.log10(context_codes(of, starts, self.end, self.tree.depth))
        head = codes >= 0
        inside = self.in_class[of] + np.where(head & (of >= self.letters.n_words), self.letters.head_log[np.maximum(codes, 0)], 0.0)
        return log_p + np.where(head, inside, 0.0), np.where(head, 0.0, inside)


def deep_contexts(codes: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of the DEEP codes before each token; whether it may be that of
    a state). The end pads. A text's start alone is left to the first kind,
    and a word that occurs once is in no context that occurs twice."""
    out, may = np.full(len(codes), np.uint64(0x51ED270B)), np.ones(len(codes), dtype=bool)
    once = (codes < 0) & ((-1 - codes) & _ONCE == _ONCE)
    for back in range(DEEP, 0, -1):
        before, bad = np.roll(codes, back), np.roll(once, back)
        for j in range(back):
            at = (starts + j)[starts + j < len(codes)]
            before[at], bad[at] = end, False
        out = (out ^ before.astype(np.uint64)) * _SPREAD
        out ^= out >> np.uint64(31)
        may &= ~bad
    may[starts] = False
    return out, may


def flagged(flags: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    place = ctx >> np.uint64(64 - BLOOM)
    return flags[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) != 0


def deep_symbols(codes: np.ndarray) -> np.ndarray:
    """A head word's place, else its class below zero."""
    return np.where(codes >= 0, codes, -1 - (-1 - codes >> RARE))


def deep_states(training: DataFrame, alphabet: Broadcast, tree: Broadcast, n_all: int, *, min_deep: int, divergence: float, discount: float) -> DataFrame:
    """(ctx, total, rest, listed): a row for each deep state, with what log10
    all unlisted followers' probability changes by and, for each listed one,
    what it changes by above that. Contexts of a text's start alone are left to
    the first kind."""

    bits = max(6, min(BLOOM, (n_all // PART).bit_length()))  # parts of about PART contexts at any size
    rest_bits = np.uint64(32 - (BLOOM - bits))

    def contexts(batches):
        end = shared(alphabet).head[END]
        for batch in text_slices(batches, column="codes", limit=6 << 20):
            codes, sizes = read_codes(batch)
            ctx, may = deep_contexts(codes, np.cumsum(sizes) - sizes, end)
            ctx, n = np.unique(ctx[may], return_counts=True)
            ctx = np.repeat(ctx, np.minimum(n, min_deep))
            part, first = np.unique((ctx >> np.uint64(64 - bits)).astype(np.int64), return_index=True)
            ends = pa.py_buffer(np.append(first, len(ctx)).astype("<i4") * np.int32(4))
            rest = pa.py_buffer((ctx << np.uint64(bits) >> np.uint64(32)).astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.Array.from_buffers(pa.binary(), len(part), [None, ends, rest])], names=["part", "rest"])

    def repeated(key, found):
        rest, n = np.unique(np.frombuffer(b"".join(found.column("rest").to_pylist()), dtype="<u4"), return_counts=True)
        place = np.unique((np.uint64(key[0].as_py()) << np.uint64(BLOOM - bits)) | (rest[n >= min_deep].astype(np.uint64) >> rest_bits))
        word, first = np.unique(place >> np.uint64(6), return_index=True)
        flag = np.uint64(1) << (place & np.uint64(63))
        return pa.table({"w": word.astype(np.int64), "v": (np.bitwise_or.reduceat(flag, first) if len(first) else flag).view(np.int64)})

    seen = training.select("codes").mapInArrow(contexts, "part long, rest binary")
    flags = share(training.sparkSession, flags_of(seen.groupBy("part").applyInArrow(repeated, "w long, v long"), BLOOM))

    def count(batches):
        score, known = Scorer(shared(alphabet), shared(tree)), shared(flags)
        end = score.letters.head[END]
        for batch in text_slices(batches, column="codes", limit=6 << 20):
            codes, sizes = read_codes(batch)
            starts = np.cumsum(sizes) - sizes
            ctx, may = deep_contexts(codes, starts, end)
            may &= flagged(known, ctx)
            ctx, sym, cost = (x[may] for x in (ctx, deep_symbols(codes), -score(codes, starts)[0]))
            _, first, n = np.unique((ctx ^ sym.astype(np.uint64)) * _SPREAD, return_index=True, return_counts=True)
            # one long holds symbol, cost in 1/256 and number: half the bytes to shuffle
            packed = (sym[first] + 4096 << 36) | (np.minimum(cost[first] * 256, 4095).astype(np.int64) << 24) | n
            yield pa.RecordBatch.from_arrays([pa.array(ctx[first].view(np.int64)), pa.array(packed)], names=["ctx", "packed"])

    # dealt by context once: the followers, the verdict on the context and its list are found where it lies
    grams = training.select("codes").mapInArrow(count, "ctx long, packed long").repartition("ctx")
    each = grams.select("ctx", (F.shiftright("packed", 36) - 4096).cast("int").alias("sym"), F.shiftright("packed", 24).bitwiseAND(F.lit(4095)).alias("cost"), F.col("packed").bitwiseAND(F.lit((1 << 24) - 1)).alias("n"))
    counted = each.groupBy("ctx", "sym").agg(F.sum("n").alias("n"), F.min("cost").alias("cost"))
    own = F.sum(F.col("n") * (F.log("n") + F.col("cost") / 256 * math.log(10)))
    states = counted.groupBy("ctx").agg(F.sum("n").alias("total"), own.alias("own"), F.collect_list(F.struct("sym", "n", "cost")).alias("after")).filter(F.col("total") >= min_deep)
    states = states.filter(F.col("own") - F.col("total") * F.log("total") >= divergence)
    rest = F.lit(discount) * F.size("after") / F.col("total")

    def delta(x):
        log_p = -x.cost / 256
        return F.log10((x.n - discount) / F.col("total") + rest * F.pow(F.lit(10.0), log_p)) - log_p - F.log10(rest)

    return states.select("ctx", "total", F.log10(rest).alias("rest"), F.map_from_entries(F.transform("after", lambda x: F.struct(x.sym, delta(x)))).alias("listed"))


def deep_changes(encoded: DataFrame, alphabet: Broadcast, states: DataFrame, n_all: int) -> DataFrame:
    """(row, delta): by how much deep states change the scores of the rows of
    encoded. A token and its state meet in one join on the context; a state
    brings its followers along, of which there are at most HEAD and CLASSES."""
    spark = encoded.sparkSession
    least = max(2, n_all // HOT)
    hot = states.filter(F.col("total") > least).select("ctx").toArrow().column("ctx").to_numpy()  # at most HOT
    sent = share(spark, (flag_table(states.select(F.shiftrightunsigned("ctx", 64 - BLOOM).alias("place")), BLOOM), np.sort(hot)))

    def find(batches):
        flags, often = shared(sent)
        end = shared(alphabet).head[END]
        for batch in text_slices(batches, column="codes", limit=4 << 20):
            codes, sizes = read_codes(batch)
            starts = np.cumsum(sizes) - sizes
            ctx, may = deep_contexts(codes, starts, end)
            at = np.flatnonzero(may & flagged(flags, ctx))
            row = batch.column("row").to_numpy()[np.searchsorted(starts, at, side="right") - 1]
            own, sym = ctx[at].view(np.int64), deep_symbols(codes[at])
            near = often[np.minimum(np.searchsorted(often, own), max(0, len(often) - 1))] == own if len(often) else np.zeros(len(own), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(own), pa.array(sym.astype(np.int32)), pa.array(np.where(near, row % SALTS, 0).astype(np.int32))], names=["row", "ctx", "sym", "salt"])

    hits = encoded.select("row", "codes").mapInArrow(find, "row long, ctx long, sym int, salt int")
    salts = F.when(F.col("total") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = states.select("ctx", "rest", "listed", F.explode(salts).alias("salt"))
    delta = F.col("rest") + F.coalesce(F.try_element_at("listed", F.col("sym")), F.lit(0.0))
    return hits.join(dealt, ["ctx", "salt"]).select("row", delta.alias("delta"))


def score_documents(docs: DataFrame, *, held_out_divisor: int = 7, held_out_remainder: int = 2, depth: int = DEPTH, min_share: float = MIN_SHARE, min_deep: int = MIN_DEEP, divergence: float = DIVERGENCE, discount: float = DISCOUNT, symbols: int = SYMBOLS, classes: int = CLASSES, head: int = HEAD) -> DataFrame:
    """Score every row of docs(doc_id, text), learning from the rows whose
    hashed id does not leave the held-out remainder.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    and score.
    """
    spark: SparkSession = docs.sparkSession
    held = F.coalesce(remainder_of_id(F.col("doc_id"), held_out_divisor) == held_out_remainder, F.lit(False))
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    counts = materialize(word_counts(docs.filter(~F.col("held_out"))))
    n_all, n_kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    letters = build_alphabet(counts, symbols, classes, head)
    alphabet = share(spark, letters)
    encoded = materialize(encode(docs, alphabet))
    training = encoded.filter(~F.col("held_out"))
    tree = share(spark, build_tree(training, letters, alphabet, depth=depth, min_share=min_share, divergence=divergence, discount=discount))
    states = materialize(deep_states(training, alphabet, tree, n_all, min_deep=min_deep, divergence=divergence, discount=discount))
    floor = math.log10(n_all + n_kinds + 1)

    def score(batches):
        known = shared(alphabet)
        scorer = Scorer(known, shared(tree))
        for batch in text_slices(batches, column="codes", limit=4 << 20):
            flat, sizes = read_codes(batch)
            starts = np.cumsum(sizes) - sizes
            log_c = np.where(flat >= 0, known.head_log[np.maximum(flat, 0)], 0.0)
            sums = ((flat >= 0) & (log_c > 0)).astype(np.int64), log_c, sum(scorer(flat, starts))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "held_out", "row")), pa.array(sizes), *(pa.array(np.add.reduceat(x, starts)) for x in sums)], names=["doc_id", "held_out", "row", "n_tokens", "head_known", "head_log", "head_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = encoded.select("doc_id", "held_out", "row", "codes").mapInArrow(score, f"doc_id {kind}, held_out boolean, row long, n_tokens long, head_known long, head_log double, head_score double")
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(counts, "word")
    none, no = F.lit(0.0), F.lit(0).cast("long")
    tails = rare.select("row", F.col("times").alias("known"), (F.col("times") * F.log10(F.col("c") + 1)).alias("log"), none.alias("delta"))
    # written, so that the shuffle of hits is gone before the last one starts
    changes = materialize(deep_changes(encoded, alphabet, states, n_all).groupBy("row").agg(F.sum("delta").alias("delta"))).select("row", no.alias("known"), none.alias("log"), "delta")
    parts = tails.unionByName(changes).groupBy("row").agg(F.sum("known").alias("known"), F.sum("log").alias("log"), F.sum("delta").alias("delta"))
    tail_log = F.coalesce("log", none)
    return scored.join(parts, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", no)).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("head_score") + tail_log + F.coalesce("delta", none)).alias("score"),
    )
