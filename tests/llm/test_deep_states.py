"""Deep states: dealt by context once, one row a state."""

import random

import numpy as np
from pyspark.sql import functions as F

from inquiro.llm import suffix_tree as st
from inquiro.llm.common import share


def test_contexts_are_dealt_once(spark):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choices("abcdeghilnorst", k=6)) for _ in range(3000)]
    texts = [" ".join(rnd.choices(vocab, k=30)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:30])), "doc_id long, text string").withColumn("held_out", F.lit(False))
    counts = st.word_counts(docs)
    letters = st.build_alphabet(counts, 60, 20, 150)
    alphabet = share(spark, letters)
    encoded = st.encode(docs, alphabet)
    tree = share(spark, st.build_tree(encoded, letters, alphabet, depth=st.DEPTH, min_share=1e-3, divergence=st.DIVERGENCE, discount=st.DISCOUNT))
    states = st.deep_states(encoded, alphabet, tree, int(letters.counts.sum()), min_deep=2, divergence=st.DIVERGENCE, discount=st.DISCOUNT)
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    rows = states.collect()
    assert len(rows) == len({r.ctx for r in rows}) > 50
    assert all(r.total >= 2 and r.listed and np.isfinite([r.rest, *r.listed.values()]).all() for r in rows)
