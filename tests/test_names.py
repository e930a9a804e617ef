"""Names by automata and by the tagger."""

import itertools
import random
import re

import numpy as np
import pytest

from inquiro.operators import extract, names, tagger


def by_patterns(text, listed):
    """One pattern a name."""
    return sorted((k, kind, *m.span()) for k, kind, name in listed if name.split() and len(name) <= 256 for m in names.pattern_of(name).finditer(text))


def test_automaton_equals_patterns():
    rng = random.Random(2)
    words = ["Ann", "ann", "LEE", "a", "b", "St.", "mary's", "Straße", "İzmir", "kızıl", "ſam", "Kelvin", "ΣΊΣΥΦΟΣ", "x_1", "new", "Delhi"]
    for seed in range(400):
        listed = [(k, rng.choice(["PERSON", "LOCATION"]), rng.choice([" ", "  "]).join(rng.choices(words, k=rng.randrange(1, 4)))) for k in range(rng.randrange(1, 12))]
        text = "".join(rng.choice(words + [w.upper() for w in words] + [w.swapcase() for w in words]) + rng.choice([" ", "  ", "\n", "\t ", ", ", ".", "", " ", "-"]) for _ in range(rng.randrange(30)))
        assert names.Names(listed)(text) == by_patterns(text, listed), (seed, text, listed)
    assert names.Names([])("x") == [] and names.Names([(0, "PERSON", " "), (1, "PERSON", "x" * 257)])("x") == []
    assert names.Names([(0, "PERSON", "a a")])("a a a a") == by_patterns("a a a a", [(0, "PERSON", "a a")])


def test_shards_give_the_same_spans(spark):
    rng = random.Random(4)
    listed = [(rng.choice(["PERSON", "LOCATION"]), f"name{k} {rng.choice('abc')}") for k in range(300)]
    docs = spark.createDataFrame([(d, " ".join(rng.choice(listed)[1] for _ in range(rng.randrange(8))) + " +919876543210") for d in range(60)] + [(60, None), (61, ""), (3, "name1 a"), (3, "name1 a")], "doc_id long, text string")
    table = spark.createDataFrame(listed, "type string, name string")
    one, many = (sorted(map(tuple, extract.extract_spans(docs, table, shard_bytes=b).collect())) for b in (1 << 20, 500))
    assert one == many and len(one) > 100
    got = sorted(tuple(r) for r in names.find_names(docs.selectExpr("doc_id as row", "text"), table, shard_bytes=500, splits=2).collect())
    numbered = [tuple(r) for r in names.listed(table).collect()]
    assert got == sorted((r.doc_id, *hit) for r in docs.collect() for hit in by_patterns(r.text or "", numbered))
    assert names.find_names(docs.selectExpr("doc_id as row", "text"), table.limit(0)).count() == 0


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4):
        scores, step = rng.normal(size=(n, len(tagger.TAGS))), rng.normal(size=(len(tagger.TAGS),) * 2)

        def total(path, scores=scores, step=step):
            if tagger.TAGS[path[0]].startswith("I-") or any(tagger.TAGS[b].startswith("I-") and tagger.TAGS[a][2:] != tagger.TAGS[b][2:] for a, b in itertools.pairwise(path)):
                return -np.inf
            return sum(scores[k, t] for k, t in enumerate(path)) + sum(step[a, b] for a, b in itertools.pairwise(path))

        assert tagger.viterbi(scores, step) == list(max(itertools.product(range(len(tagger.TAGS)), repeat=n), key=total))
    assert tagger.viterbi(np.zeros((0, len(tagger.TAGS))), np.zeros((len(tagger.TAGS),) * 2)) == []


def test_average_is_that_of_all_steps():
    """The lazy average equals the mean of the weights after each example."""
    rng = random.Random(6)
    examples = [(tagger.features([rng.choice(["Ann", "met", "Bob", "in", "Pune"]) for _ in range(4)]), [rng.randrange(2) for _ in range(4)]) for _ in range(12)]
    _, mean = tagger.corrected(tagger.Weights(), examples)
    now, sums = tagger.Weights(), np.zeros_like(tagger.Weights().of)
    for e in examples:
        now, _ = tagger.corrected(now, [e])
        sums += now.of
    assert np.allclose(mean.of, sums / len(examples))


PEOPLE, FIRMS, TOWNS = ("Asha Bela Chand Dilip Esha Farid Gita Hari Indu Jaya Kiran Lata Mohan Nila Omar Priya".split(), "Apex Birla Crest Delta Emerald Falcon Garuda Horizon".split(), "Agra Bhopal Cuttack Dhule Erode Firozabad Gaya Hubli Indore Jhansi".split())
FORMS = ["Witness {p} met {q} near {t}.", "{p} works for {o} in {t}.", "A van of {o} was seen at {t} by {p}.", "The complainant {p} paid {o} on Monday.", "Nothing was found near the river.", "Officers from {t} spoke to {p} and {q}."]


def reports(rng, n):
    """(text, spans) with names of two parts, of which few repeat."""
    out = []
    for _ in range(n):
        person = lambda: f"{rng.choice(PEOPLE)} {rng.choice(PEOPLE)}{rng.choice(['an', 'esh', 'ita', ''])}"
        fill = {"p": person(), "q": person(), "o": f"{rng.choice(FIRMS)} {rng.choice(['Traders', 'Motors', 'Bank'])}", "t": rng.choice(TOWNS)}
        form, text, spans = rng.choice(FORMS), "", []
        for part in re.split(r"(\{\w\})", form):
            if part.startswith("{"):
                value = fill[part[1]]
                spans.append(({"p": "PERSON", "q": "PERSON", "o": "ORGANIZATION", "t": "LOCATION"}[part[1]], len(text), len(text) + len(value)))
                part = value
            text += part
        out.append((text, spans))
    return out


def test_held_out_names_are_found(spark):
    rng = random.Random(8)
    train, held = reports(rng, 300), reports(rng, 200)
    kind = "doc_id long, text string, spans array<struct<kind:string,start:long,end:long>>"
    weights = tagger.train(spark.createDataFrame([(k, *r) for k, r in enumerate(train)], kind).repartition(3))
    again = tagger.train(spark.createDataFrame([(k, *r) for k, r in enumerate(train)], kind).repartition(7))
    assert np.allclose(weights.of, again.of)  # whatever the partitions
    listed = {text[s:e] for text, spans in train for _, s, e in spans}
    hit = made = true = new = new_hit = 0
    for text, spans in held:
        got = set(tagger.spans_of(text, weights))
        hit, made, true = hit + len(got & set(spans)), made + len(got), true + len(spans)
        unseen = [x for x in spans if text[x[1] : x[2]] not in listed]
        new, new_hit = new + len(unseen), new_hit + len(got & set(unseen))
    f1 = 2 * hit / (made + true)
    print("held-out F1", round(f1, 3), "of unlisted names found", new_hit, "of", new)
    assert f1 > 0.95 and new > 100 and new_hit > 0.9 * new
    docs = spark.createDataFrame([(1, "Witness Zubin Wadia met Asha Chandan near Agra."), (2, None)], "doc_id long, text string")
    got = {(r.raw, r.type, r.method, r.confidence, r.nlp_backend) for r in extract.extract_spans(docs, [("LOCATION", "Agra")], weights=weights).collect()}
    assert {("Agra", "LOCATION", "gazetteer", 0.85, "ner+rules"), ("Asha Chandan", "PERSON", "ner_person", 0.90, "ner+rules"), ("Zubin Wadia", "PERSON", "ner_person", 0.90, "ner+rules")} <= got


def test_learning_from_a_gazetteer(spark):
    rng = random.Random(9)
    made = reports(rng, 250)
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(made)], "doc_id long, text string")
    listed = spark.createDataFrame([(kind, text[s:e]) for text, spans in made for kind, s, e in spans] + [("PERSON", "Asha")], "type string, name string").distinct()
    weights = extract.learn_names(docs, listed)
    held = reports(rng, 100)
    hit = sum(len(set(tagger.spans_of(t, weights)) & set(s)) for t, s in held)
    assert hit > 0.9 * sum(len(s) for _, s in held)
    assert not tagger.train(docs.selectExpr("doc_id", "text", "cast(null as array<struct<kind:string,start:long,end:long>>) as spans").limit(0)).of.any()


@pytest.mark.parametrize("text", ["", " \n", "...", "x", "a" * 300_000, "ß퟿🙂 É."])
def test_odd_texts(text):
    assert tagger.spans_of(text, tagger.Weights()) == []


def test_many_texts_are_tagged_as_each_alone():
    """Features, paths and spans of a batch are those of one sentence after the other."""
    rng = np.random.default_rng(8)
    words = ["Ann", "ann", "<", "s", ">", "</s>", "İpek", "ß", "met", "Pune", "9876", "x_1", ".", "MacLeod", "東京"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 14))) + rng.choice(["", ". Then\n\nhe left!", " \n"]) for _ in range(300)] + ["", " "]
    lists = [[t[a:b] for a, b in tagger.tokens(t)] for t in texts]
    assert (tagger.features_of(lists) == np.concatenate([tagger.features(w) for w in lists])).all()
    sizes = np.array([len(w) for w in lists])
    # whole numbers: ties are met too
    scores, step = rng.integers(-2, 3, size=(sizes.sum(), len(tagger.TAGS))).astype(float), rng.integers(-1, 2, size=(len(tagger.TAGS),) * 2).astype(float)
    one_by_one = [tagger.viterbi(x, step) for x in np.split(scores, np.cumsum(sizes)[:-1])]
    assert tagger.viterbi_of(scores, sizes, step).tolist() == sum(one_by_one, [])
    weights = tagger.Weights(rng.normal(size=(1 << tagger.BITS, len(tagger.TAGS))), step)
    assert tagger.spans_of_texts(texts, weights) == [tagger.spans_of(t, weights) for t in texts]


def test_documents_with_names_are_counted_once(spark, monkeypatch):
    """Places are looked for in the drawn documents alone, by lists and by shards."""
    docs = spark.createDataFrame([(k, f"Ann Lee met nobody {k}" if k % 4 else None if k % 8 else "no one") for k in range(400)], "doc_id long, text string")
    listed = spark.createDataFrame([("PERSON", "ann lee"), ("PERSON", "Lee"), ("PERSON", None)], "type string, name string")
    assert names.count_named(docs, listed) == names.count_named(docs, listed, shard_bytes=4) == 300
    read, found = [], names.find_names
    monkeypatch.setattr(names, "find_names", lambda d, *a, **k: read.append(d.count()) or found(d, *a, **k))
    extract.learn_names(docs, listed, most_documents=60, rounds=1)
    assert 0 < sum(read) < 200
