"""The trie of rebuilt conversations against brute force."""

import hashlib
import random
import zlib

import pytest
from test_line_dedup import ranges

from inquiro.llm import prefix_trie
from inquiro.llm.ranges import running

SCHEMA = "conv_id long, turn long, role string, text string, extra int"


def brute(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    words = lambda p: len(p[-1][1].encode().split()) if p else 0
    out = []
    for p, who in members.items():
        under = [q for q in members if q[: len(p)] == p]
        childless = [q for q in under if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in under)]
        ends = ",".join(str(c) for c in sorted(who) if built[c] == p)
        kids = sum(len(q) == len(p) + 1 for q in under)
        saved = sum((len(members[q]) - 1) * words(q) for q in under)
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)


@pytest.mark.parametrize("batch", [2, 10_000])
def test_against_brute_force(spark, batch):
    rng = random.Random(batch)
    rows = []
    for c in range(45):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hello there", "one two  three", "", "x", "é y"]), 1))
    with ranges(spark, batch):
        assert nodes(spark, rows) == brute(rows)


def test_long_and_repeated(spark):
    """One conversation holds most rows; many conversations are the same."""
    rows = [(0, t, "user", f"turn {t % 3}", 0) for t in range(150)]
    rows += [(20 * k, t, "user", f"turn {t % 3}", 0) for k in range(1, 30) for t in range(4)]
    with ranges(spark, 4):
        assert nodes(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [
        (None, 0, "user", "belongs to nobody", 0), (7, None, "b", "null turn first", 0), (7, 0, None, None, 0), (7, 0, None, None, 0),
        (7, 1, "z", "tie", 0), (7, 1, "a", "tie", 0), (41, 0, "user", "loses all", 0), (-3, 0, "user", "a", 0), (-3, 1, "user", "b", 0), (-3, 2, "user", "c", 0), (-3, 3, "user", "d", 0),
        (2, 0, "ab", "c", 0), (2, 1, "a", "bc", 0), (5, 0, "a", "long " * 50_000, 0),
    ]
    assert nodes(spark, rows) == brute(rows)
    assert nodes(spark, []) == []
    assert nodes(spark, [(60, 0, "user", "one", 0)]) == brute([(60, 0, "user", "one", 0)])


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, rng.randrange(-5, 9)) for k in range(200)]
    for batch in (1, 7, 1000):
        with ranges(spark, batch):
            got = {(r.k, r.n): (r.run_v, r.run_w) for r in running(spark.createDataFrame(rows, "k long, n long, v long").selectExpr("*", "v as w"), "k", ["n"], sums=["v"], xors=["w"]).collect()}
        want, sums, xors = {}, {}, {}
        for k, n, v in sorted(rows):
            sums[k], xors[k] = sums.get(k, 0) + v, xors.get(k, 0) ^ v
            want[k, n] = (sums[k], xors[k])
        assert got == want
