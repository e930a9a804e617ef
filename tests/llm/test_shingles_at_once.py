"""Shingle sets are made for all texts of a batch together."""

import pyarrow as pa

from inquiro.llm import near_copies


def test_sets_hold_what_words_say(monkeypatch):
    """Sets meet as sets of five words do; no hash function is called shingle
    by shingle."""
    texts = ["", None, " \t", "a", "ab", "a b", "a b c d", "a b c d e", " A  b\tc\nd e ", "a b c d e f", "b c d e f g", "x\xa0y é Ü z q", "a b c d e f " * 40, " ".join(f"w{i}" for i in range(5000))]
    words = [(t or "").encode().lower().split() for t in texts]
    want = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    calls, plain = [], near_copies.xxhash.xxh64_intdigest
    monkeypatch.setattr(near_copies.xxhash, "xxh64_intdigest", lambda *a, **b: calls.append(1) or plain(*a, **b))
    sets, names = near_copies.shingle_sets(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), 5)
    assert len(calls) <= 2 * len(texts)
    names = names.to_pylist()
    for i in range(len(texts)):
        assert (sets[i][1:] > sets[i][:-1]).all()
        for j in range(len(texts)):
            assert len(set(sets[i].tolist()) & set(sets[j].tolist())) == len(want[i] & want[j])
            assert (names[i] == names[j]) == (want[i] == want[j])
