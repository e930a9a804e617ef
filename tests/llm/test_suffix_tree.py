"""Suffix tree scoring: the deep states by hand, what doubles tell, cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from inquiro.llm import suffix_tree as st
from inquiro.llm.common import remainder_of_id, share
from pyspark.sql import functions as F

RND = random.Random(11)
VOCAB = ["".join(RND.choices("abcdeghilnorst", k=RND.randint(2, 8))) for _ in range(300)]


def corpus():
    texts = [" ".join(RND.choices(VOCAB, k=RND.randint(1, 60))) for _ in range(200)]
    for k in range(20):  # repeated stretches, and whole copies
        texts.append(" ".join(RND.choices(VOCAB, k=10) + texts[k].split()[:25] + RND.choices(VOCAB, k=5)))
    return texts + texts[30:40] + ["", "x", None, "w " * 3000]


def test_scores_by_hand(spark):
    """The first kind's probabilities from the model, all else in plain loops."""
    texts = corpus()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    settings = {"symbols": 60, "classes": 20, "head": 150}
    got = {r.doc_id: r.score for r in st.score_documents(frame, min_share=1e-3, **settings).collect()}

    docs = frame.select("doc_id", "text", (remainder_of_id(F.col("doc_id"), 7) == 2).alias("held_out"))
    held = {r.doc_id: r.held_out for r in docs.select("doc_id", "held_out").collect()}
    counts = st.word_counts(docs.filter("not held_out"))
    count = {bytes(r.word): r.c for r in counts.collect()}
    letters = st.build_alphabet(counts, **settings)
    encoded = st.encode(docs, share(spark, letters))
    tree = st.build_tree(encoded.filter("not held_out"), letters, share(spark, letters), depth=st.DEPTH, min_share=1e-3, divergence=st.DIVERGENCE, discount=st.DISCOUNT)
    scorer = st.Scorer(letters, tree)
    tokens = {}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        codes = np.array(letters.read(words)[0], dtype=np.int64)
        tokens[i] = words + [st.END], codes, *scorer(codes, np.array([0]))
    follow, cost = defaultdict(Counter), {}
    context = lambda codes, k: tuple(([letters.head[st.END]] * 4 + codes.tolist())[k : k + 4])
    symbol = lambda code: code if code >= 0 else ("class", -1 - code >> st.RARE)
    for i, (_, codes, log_p, _) in tokens.items():
        if not held[i]:
            for k in range(1, len(codes)):
                follow[context(codes, k)][symbol(codes[k])] += 1
                cost[context(codes, k), symbol(codes[k])] = math.floor(min(-log_p[k] * 256, 4095)) / 256
    states = {}
    for c, after in follow.items():
        n = sum(after.values())
        gain = sum(m * (math.log(m / n) + cost[c, s] * math.log(10)) for s, m in after.items())
        if n >= 2 and gain >= st.DIVERGENCE:
            states[c] = n, after
    assert len(states) > 30
    for i, (words, codes, log_p, inside) in tokens.items():
        want = 0.0
        for k, w in enumerate(words):
            p = log_p[k]
            if k and context(codes, k) in states:
                n, after = states[context(codes, k)]
                s, rest = symbol(codes[k]), st.DISCOUNT * len(after) / n
                p += math.log10((after[s] - st.DISCOUNT) / n + rest * 10 ** -cost[context(codes, k), s]) + cost[context(codes, k), s] if s in after else math.log10(rest)
            want += p + inside[k] + (0.0 if codes[k] >= 0 else math.log10(count.get(w, 0) + 1))
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want)), i


def test_texts_that_occur_twice_stand_out(spark):
    many = ["".join(RND.choices("abcdeghilnorst", k=6)) for _ in range(3000)]
    texts = [" ".join(RND.choices(many, k=40)) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + k, texts[k]) for k in range(40)]
    got = {r.doc_id: r for r in st.score_documents(spark.createDataFrame(rows, "doc_id int, text string"), min_share=1e-3).collect()}
    twice = [got[k].score / got[k].n_tokens for k in range(40) if not (got[k].held_out or got[1000 + k].held_out)]
    once = [got[k].score / got[k].n_tokens for k in range(40, 300)]
    assert min(twice) > max(once)
    assert np.mean([r.score - r.base_score for r in got.values()]) > 0


def test_cases(spark):
    rows = [(5, "a b c"), (5, "a b c"), (None, "a b c"), (6, None), (7, "d " * 50_000)]
    got = st.score_documents(spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id short, text string, score double, codes string")).collect()
    assert len(got) == 5 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = [r for r in got if r.doc_id == 5]
    assert same[0].score == same[1].score and same[0].n_tokens == 4
    assert st.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = [i for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 7 == 2][:2]
    held = st.score_documents(spark.createDataFrame([(i, "a b") for i in only], "doc_id long, text string")).collect()
    assert {r.train_tokens for r in held} == {0} and all(math.isfinite(r.score) for r in held)
