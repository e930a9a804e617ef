"""The stage's candidates: SimHash bands find pairs at the radius."""

import random

import numpy as np
import pytest

from inquiro.llm import near_copies, toxicity


@pytest.mark.parametrize("common, more, nodes", [(4, 1, 50_000), (8, 1, 50_000), (40, 5, 50_000), (400, 50, 50_000), (40, 5, 20_000_000)])
def test_recall_at_the_radius(common, more, nodes):
    """Pairs of similarity `common` / (`common` + 2 x `more`), or one more side
    where that is below 0.8."""
    rng = np.random.default_rng(common)
    sides = 2 if common >= 0.8 * (common + 2 * more) else 1
    sets = []
    for _ in range(500):
        x = rng.integers(0, 1 << 48, common + 2 * more, dtype=np.uint64)
        sets += [np.unique(x[: common + more]), np.unique(np.concatenate([x[:common], x[common + more :]])) if sides == 2 else np.unique(x[:common])]
    bits = np.unpackbits(near_copies.wide_fingerprints(sets), axis=1, bitorder="little")
    left, right = bits[::2], bits[1::2]
    meet = np.zeros(500, bool)
    for places in near_copies.bands_of(nodes):
        meet |= (left[:, places] == right[:, places]).all(axis=1)
    close = (left[:, : near_copies.CHECK] != right[:, : near_copies.CHECK]).sum(axis=1) <= near_copies.NEAR
    assert (meet & close).mean() >= 0.99
    unlike = (bits[::2] != np.roll(bits[::2], 1, axis=0)).mean()
    assert 0.45 < unlike < 0.55


def test_stage_is_simhash_not_minhash():
    """A bit is the majority over the shingles, the least one decides ties."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64)) for n in (1, 2, 3, 7, 9000, 20_000)]
    one = np.unpackbits(near_copies.wide_fingerprints([s[k : k + 1] for s in sets for k in range(len(s))]), axis=1, bitorder="little")
    at = 0
    for s, got in zip(sets, np.unpackbits(near_copies.wide_fingerprints(sets), axis=1, bitorder="little")):
        own = one[at : at + len(s)].astype(int)
        at += len(s)
        assert (got == (2 * own.sum(axis=0) + own[0] > len(s))).all()


def test_renamed_rows_part_by_part():
    rnd = random.Random(3)
    sets = [sorted(rnd.sample(range(90), rnd.randint(0, 20))) for _ in range(700)]
    to = np.array([i // 2 if i % 3 else -1 for i in range(90)])
    rows = toxicity.Rows.of(sets)
    got = rows.renamed(to)
    want = [[to[x] for x in s if to[x] >= 0] for s in sets]
    assert got.sizes.tolist() == [len(x) for x in want] and got.flat.tolist() == [x for s in want for x in s]
    assert rows.counts(90).tolist() == np.bincount(rows.flat, minlength=90).tolist()
