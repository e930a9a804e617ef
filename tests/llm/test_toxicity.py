"""The factorization machine: pairs that no weight explains, its sum against
all pairs one by one, accuracy on held-out rows, defined cases."""

import random
import zlib

import numpy as np

from inquiro.llm import toxicity

RND = random.Random(4)
VOCAB = ["".join(RND.choices("abcdeghilnorst", k=RND.randint(3, 9))) for _ in range(400)]


def labelled(spark, n, kind):
    """Rows whose label only a pair of terms tells."""
    rows = []
    for i in range(n):
        a, b = RND.randrange(2), RND.randrange(2)
        if kind == "and":
            said = [w for w, k in (("alphaterm", RND.random() < 0.5), ("betaterm", RND.random() < 0.5)) if k]
            toxic = len(said) == 2
        else:  # an insult with its own group only; either alone or crossed is harmless
            said = [("alphaterm", "gammaterm")[a], ("betaterm", "deltaterm")[b]] if RND.random() < 0.7 else []
            toxic = bool(said) and a == b
        words = RND.choices(VOCAB, k=25) + said
        RND.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), rows


def test_pairs_are_learned(spark):
    for kind in ("and", "crossed"):
        docs, labels, rows = labelled(spark, 3000, kind)
        said = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels).collect()}
        held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
        toxic = [said[r[0]] for r in held if r[2]]
        assert np.mean(toxic) >= 0.9 and np.mean([said[r[0]] for r in held if not r[2]]) <= 0.02, kind


def test_pair_sum_is_that_of_all_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.FactorizationMachine({}, 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    sets = [set(), {3}, {1, 5, 9, 19}, set(range(20))]
    want = [0.3 + sum(machine.weights[i] for i in s) + sum(machine.factors[i] @ machine.factors[j] for i in s for j in s if i < j) for s in sets]
    assert np.allclose(machine.logits(toxicity.Rows.of(sets)), want)
    assert np.allclose(machine.score(sets), 1 / (1 + np.exp(-np.array(want))))


def test_evidence_is_the_likelihood_ratio():
    rows, toxic = toxicity.Rows.of([{0, 1}, {0}, {1}, {0, 1}]), np.array([1.0, 1.0, 0.0, 0.0])
    got = toxicity.evidence(rows, toxic, 2)
    cells = lambda t, d: [(t, d / 2), (d - t, d / 2), (2 - t, (4 - d) / 2), (2 - d + t, (4 - d) / 2)]
    assert np.allclose(got, [2 * sum(o * np.log(o / e) for o, e in cells(t, d) if o) for t, d in ((2, 3), (1, 3))])


def test_held_out_accuracy_with_inflected_stems(spark):
    rows = []
    for i in range(1800):
        words, toxic = RND.choices(VOCAB, k=40), i % 6 == 0
        if toxic:
            words[3:6] = ["grumble" + RND.choice(VOCAB) for _ in range(3)] if i % 12 else ["zorkhead"] * 3
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert np.mean([got[r[0]].predicted for r in held if r[2]]) >= 0.95 and sum(got[r[0]].predicted for r in held if not r[2]) <= 2
    left = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert left == {k for k, r in got.items() if not r.predicted}


def test_defined_cases(spark):
    texts = [(i, "badword here" if i % 2 else "calm here", "x", 0.5) for i in range(300)]
    texts += [(1, "another text of id one", "x", 0.5), (7, "badword here", "x", 0.5), (None, "badword here", "x", 0.5), (900, None, "x", 0.5), (901, "", "x", 0.5), (902, "calm " * 60_000 + "badword", "x", 0.5)]
    docs = spark.createDataFrame(texts, "doc_id int, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(4, None), (6, 0), (6, 0), (None, 1)], "doc_id int, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True] and [r.predicted for r in got if r.doc_id is None] == [1]
    empty = {r.doc_id: r.score for r in got}
    assert empty[900] == empty[901] < 0.7 and len({r.score for r in got if r.doc_id == 7}) == 1
    assert len({r.score for r in toxicity.score_documents(docs, labels.filter("toxic = 0")).collect()}) == 1
    assert {r.score for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0} or max(r.score for r in toxicity.score_documents(docs, labels.limit(0)).collect()) < 1e-6
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(texts) and toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_levels_count_different_words():
    bucket = toxicity.prefix_term(b"abcd")
    two, three = (toxicity.level_term(bucket, k) for k in toxicity.LEVELS)
    terms = toxicity.Terms()
    assert two not in terms(b"abcdxx abcdxx, ABCDXX!") and two in terms(b"abcdxx abcdyy")
    assert three not in terms(b"abcdxx abcdyy") and three in terms(b"abcdxx abcdyy abcdzz")
    assert toxicity.Terms({two: 7})(b"abcdxx. abcdyy abcdzz") == {7}
