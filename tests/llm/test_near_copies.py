"""The near_dedup stage against brute force, with planted edited copies."""

import random

from inquiro.llm import near_copies, simhash


def test_edited_copies_go(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdeghilnorst", k=5))
    texts = [[word() for _ in range(rnd.randint(60, 160))] for _ in range(40)]
    for t in texts[:30]:  # edited copies, one to six replaced words
        for n in (1, 2, 6):
            copy = list(t)
            for at in rnd.sample(range(len(t)), n):
                copy[at] = word()
            texts.append(copy)
    base = texts[0]
    for k in range(60):  # a crowd over several tiles: its links are chains, its pairs mostly are none
        texts.append([*base[: 100 - 20], *[f"w{k}x{j}" for j in range(rnd.randint(1, 40))]])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, " ".join(texts[0]))]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for _, t in rows)]
    group, linked = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                linked += sets[i] != sets[j]
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(r[0] for r, h in zip(rows, group) if h == g and r[0] is not None) for g in set(group)}
    assert linked > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_copies.near_copies(docs, tile=16).collect()}
    assert got == {(r[0], least[g]) for r, g in zip(rows, group)}
    assert sorted(r.doc_id for r in simhash.one_per_group(docs).collect()) == sorted(set(least.values()))
    assert simhash.one_per_group(docs.limit(0)).count() == 0
