"""A dense group of near copies gives links in proportion to its nodes."""

import numpy as np

from inquiro.llm import near_copies
from inquiro.operators.stars import components


def test_rows_of_a_dense_group_and_its_components(spark):
    rng, n = np.random.default_rng(5), 400
    base = rng.integers(0, 2, near_copies.BITS, dtype=np.uint8)
    rows = []
    for k in range(n):  # 10 of 512 bits turned: most meet in every band
        bits = base.copy()
        bits[rng.choice(near_copies.BITS, 10, replace=False)] ^= 1
        rows.append((k, bytearray(np.packbits(bits, bitorder="little").tobytes())))
    rows += [(n + k, bytearray(rng.bytes(near_copies.BITS // 8))) for k in range(20)]
    links = near_copies.candidate_links(spark.createDataFrame(rows, "fp long, bits binary"), len(rows), tile=16).localCheckpoint()
    assert links.count() < 8 * n  # a forest of each pair of parts in each band were over 30 times n
    assert {(r.node, r.root) for r in components(links).collect()} == {(k, 0) for k in range(n)}
    sets = [(int(k), bytearray(np.arange(60 + k % 2, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())) for k in range(n)]
    parts = [([{"fp": f, "shingles": s} for f, s in sets[a : a + 16] + (sets[b : b + 16] if b > a else [])], 16 if b > a else 0) for a in range(0, n, 16) for b in range(a, n, 16)]
    tiles = spark.createDataFrame(parts, "nodes array<struct<fp long, shingles binary>>, own int")
    exact = near_copies._links(tiles, 0.8).localCheckpoint()
    assert exact.count() < 2 * n
    assert {(r.node, r.root) for r in components(exact).collect()} == {(k, 0) for k in range(n)}


def test_joins_across_parts_lose_none():
    rng = np.random.default_rng(6)
    for _ in range(200):
        names = rng.integers(0, 12, 14).astype(np.uint64)
        i, j = np.nonzero(np.triu(rng.random((14, 14)) < 0.1, 1))
        own = 6
        within = (i < own) == (j < own)
        a, b = near_copies.joins(names, own, i, j)
        all_a, all_b = near_copies.joins(names, 0, i, j)
        group = lambda links: near_copies._labels(12, *(np.array(x, dtype=np.int64) for x in links))
        got = group(([*names[i[within]], *a], [*names[j[within]], *b]))
        assert (got == group((all_a, all_b))).all() and (got == group((names[i], names[j]))).all()
