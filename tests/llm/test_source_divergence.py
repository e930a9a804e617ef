"""Divergences of sources against brute force, over many cells."""

import random
import re
from collections import Counter

import pytest

from inquiro.llm import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top=50):
    docs = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        whole = sum(counts.values(), Counter())
        for s, c in counts.items():
            pairs = [(o, sum(abs(p(c, t) - p(counts[o], t)) for t in kept)) for o in counts if o != s]
            terms = [(t, p(c, t) - p(whole, t)) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return sorted(out)


def rows_of(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, source string, term string")
    return sorted(tuple(r) for r in source_divergence.divergence(docs, **settings).collect())


@pytest.mark.parametrize("blocks", [{"source_block": 2, "term_block": 3}, {"source_block": 32, "term_block": 8192}])
def test_against_brute_force(spark, blocks):
    rng = random.Random(5)
    words = [*"alpha Beta gamma DELTA épée ünder naïve 日本 x y z word2word don't a_b".split(), *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "en", "de"]), f"s{rng.randrange(7)}") for _ in range(150)]
    rows += [("aa bb", "en", "huge")] * 80  # one source with a third of all rows
    assert rows_of(spark, rows, least_documents=4, **blocks) == brute(rows, 4)


def test_defined_cases(spark, monkeypatch):
    rows = [(None, None, None), ("", "en", "empty"), ("12 34 []", "en", "no terms"), ("Ab ab aB", "en", "s"), ("ab cd", "en", "t"), ("ab", None, "s"), ("ab", "fr", None), ("ab", "fr", "only once " * 10), ("cd", "xx", "alone"), ("ab ab", "en", "s"), ("tie tie cd", "en", "t"), ("tie cd", "en", "t")]
    for least in (1, 2, 3, 99):
        assert rows_of(spark, rows, least_documents=least) == brute(rows, least)
    assert rows_of(spark, [], least_documents=1) == []
    monkeypatch.setattr(source_divergence, "FLUSH", 3)  # counts leave a task in many parts
    assert rows_of(spark, rows, least_documents=2) == brute(rows, 2)
    assert rows_of(spark, rows, least_documents=1, top=1) == brute(rows, 1, 1)


def test_long_text_and_large_counts(spark):
    rows = [("ab " * 300_000 + "cd", "en", "s"), ("ab cd", "en", "t")]
    assert rows_of(spark, rows, least_documents=1) == brute(rows, 1)
    huge = 10**13  # a count at which a long would overflow
    got = spark.range(1).selectExpr(f"{huge}L as n", f"{3 * huge}L as total", "7L as kinds").select(source_divergence._probability("n", "total", "kinds").alias("p")).first().p
    assert got == 1 + 10**9 * (huge + 5) // (3 * huge + 35)
