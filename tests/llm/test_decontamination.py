"""Decontamination against plain dynamic programming, and its recall at the
radius by item length and kind of edit."""

import random

import numpy as np
import pytest

from inquiro.llm import decontamination as d

RND = random.Random(5)
LETTERS = "abcdeghilnorst"


def word():
    return "".join(RND.choices(LETTERS, k=6))


def plain_distance(item, text):
    """Least edit distance of item to any stretch of text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != t)))
        row = new
    return min(row)


def test_nearest_distance_is_the_plain_one():
    rnd = random.Random(2)
    for _ in range(400):
        item, text = (rnd.choices([b"a", b"b", b"c"], k=rnd.randint(1, 12)) for _ in range(2))
        text *= rnd.randint(0, 2)
        masks = {w: sum(1 << i for i, x in enumerate(item) if x == w) for w in item}
        assert d.nearest_distance(item, text, masks) == plain_distance(item, text)


def edit(words, k, kind):
    out = list(words)
    if kind == "front":
        return out[k:]
    if kind == "back":
        return out[: len(out) - k]
    for _ in range(k):
        op, at = kind if kind != "mixed" else RND.choice(["replaced", "added", "lost"]), RND.randrange(len(out))
        out[at : at + (op != "added")] = [] if op == "lost" else [word()]
    return out


@pytest.mark.parametrize("kind", ["replaced", "added", "lost", "mixed", "front", "back"])
def test_recall_at_the_radius(spark, kind):
    lengths, each = (1, 2, 4, 5, 6, 8, 10, 12, 16, 20, 25, 33, 50, 64, 65, 100, 190), 40
    items, docs = [], []
    for n in lengths:
        for _ in range(each):
            items.append([word() for _ in range(n)])
            docs.append([word() for _ in range(RND.randint(0, 30))] + edit(items[-1], int(0.2 * n), kind) + [word() for _ in range(RND.randint(0, 30))])
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id int, text string")
    bench = spark.createDataFrame([(str(i), " ".join(w)) for i, w in enumerate(items)], "item_id string, text string")
    got = {(r.doc_id, int(r.item_id)): r.distance for r in d.find_leaks(frame, bench).collect()}
    for k, n in enumerate(lengths):
        assert np.mean([(i, i) in got for i in range(k * each, (k + 1) * each)]) >= 0.9, n
    wrong = [(i, j) for (i, j), away in got.items() if plain_distance(items[j], docs[i]) > int(0.2 * len(items[j]))]
    assert not wrong and all(plain_distance(items[j], docs[i]) <= away for (i, j), away in list(got.items())[::7])


def test_all_pairs_on_a_shared_vocabulary(spark):
    """Few words, so that chance likeness abounds: nothing false, and 0.9 of
    all true pairs."""
    vocab = [word() for _ in range(60)]
    items = [RND.choices(vocab, k=RND.randint(1, 14)) for _ in range(60)]
    docs = [RND.choices(vocab, k=RND.randint(0, 80)) for _ in range(120)]
    want = {(i, j): x for i, t in enumerate(docs) for j, w in enumerate(items) if (x := plain_distance(w, t)) <= int(0.2 * len(w))}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in d.find_leaks(frame, bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and all(want[k] <= v for k, v in got.items())


def test_repeated_rows_items_long_texts_and_chunks(spark):
    items = [[word() for _ in range(n)] for n in (5, 12, 30)]
    text = " ".join(items[1])
    long = " ".join(word() for _ in range(120_000))
    rows = [(1, text), (1, text), (None, text.upper() + "!"), (2, long + " " + " ".join(items[2]) + " " + long), (3, None), (4, ""), (5, " ... ")]
    frame = spark.createDataFrame([(*r, r[0], "x") for r in rows], "doc_id long, text string, item_id long, distance string")
    bench = spark.createDataFrame([(k, " ".join(w), 0) for k, w in enumerate(items)] + [(1, text, 0), (None, text, 0), (9, None, 0)], "item_id short, text string, doc_id int")
    got = sorted(((r.doc_id or 0, r.item_id if r.item_id is not None else -1) for r in d.find_leaks(frame, bench, chunk=2).collect()))
    assert got == sorted([(1, 1), (1, 1), (1, -1)] * 2 + [(0, 1), (0, 1), (0, -1), (2, 2)])
    left = d.drop_leaks(frame, bench, chunk=2)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5]
    assert d.find_leaks(frame, bench.limit(0)).count() == 0 and d.find_leaks(frame.limit(0), bench).count() == 0
