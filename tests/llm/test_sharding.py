"""Balanced label propagation: sizes, groups, cut links, hot groups."""

import random
import zlib
from collections import Counter, defaultdict

from inquiro.llm import sharding

RND = random.Random(7)


def line():
    return " ".join("".join(RND.choices("abcdeghilnorst", k=6)) for _ in range(8))


def sharded(spark, rows, **kw):
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id int, text string, shard int, slot string")
    return sharding.shard_documents(frame, **kw).collect()


def sizes(got, n):
    out = Counter({s: 0 for s in range(n)})
    for r in got:
        out[r.shard] += r["size"]
    return out


def test_linked_documents_meet_and_sizes_are_even(spark):
    shared = [line() for _ in range(60)]  # clusters of ten documents
    rows = [(c * 10 + k, "\n".join([shared[c], line(), shared[c] + "x", line()])) for c in range(60) for k in range(10)]
    got = sharded(spark, rows, n_shards=4)
    load = sizes(got, 4)
    assert len(got) == 600 and max(load.values()) - min(load.values()) <= 0.06 * sum(load.values()) / 4
    where = {r.doc_id: r.shard for r in got}
    together = sum(Counter(where[c * 10 + k] for k in range(10)).most_common(1)[0][1] for c in range(60))
    assert together >= 0.75 * 600  # random shards keep about 4.4 of 10 together
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_groups_stay_whole_where_they_fit(spark):
    copies = [line() * 3 for _ in range(12)]
    rows = [(k, copies[k % 12]) for k in range(120)] + [(1000 + k, line() * 2) for k in range(300)]
    got = sharded(spark, rows, n_shards=4)
    shards = defaultdict(set)
    for r in got:
        shards[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    load = sizes(got, 4)
    assert max(load.values()) <= 1.03 * sum(load.values()) / 4 + 1


def test_a_hot_group_spreads(spark):
    hot = line() * 4
    rows = [(k, hot) for k in range(300)] + [(1000 + k, line() * 4) for k in range(600)] + [(None, None), (5000, None), (5001, ""), (7, hot), (7, hot)]
    got = sharded(spark, rows, n_shards=8)
    load = sizes(got, 8)
    assert max(load.values()) <= 1.06 * sum(load.values()) / 8
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharded(spark, [(1, "x")], n_shards=4)[0].slot == 0
