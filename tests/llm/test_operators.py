"""Each operator against brute force, on edge cases: nulls, empty and long
texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from inquiro.llm import chat_template, line_rules, link_filter, mixing, sharding, simhash, suffix_tree, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long"
RND = random.Random(3)
VOCAB = ["".join(RND.choices("abcdeghilnorst", k=RND.randint(2, 8))) for _ in range(400)]


def prose(n, rnd=RND):
    return " ".join(rnd.choices(VOCAB, k=n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(RND.randint(20, 120)), "en", f"s{i % 4}", 0, 0.5, 1) for i in range(120)]
    out += [(200, out[3][1], "en", "s0", 0, 0.5, 1), (201, None, "en", None, 0, 0.5, 1), (202, "", "en", "s1", 0, 0.5, 1), (203, prose(4000), "en", "s1", 0, 0.5, 1)]
    out += [(5, out[5][1], "en", "s1", 0, 0.5, 1), (None, "Null id with Some words", "en", "s2", 0, 0.5, 1), (204, " \n\t ", "en", "s2", 0, 0.5, 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_suffix_tree(docs, rows, none):
    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for r in rows:
        if not held(r[0]):
            c.update(w.lower() for w in words(r[1]))
            c[b"\n"] += 1
    n, v = sum(c.values()), len(c)
    got = suffix_tree.score_documents(docs, head=50, symbols=20, classes=10).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        t = [w.lower() for w in words(r[1])] + [b"\n"]
        want[r[0], held(r[0]), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)] += 1
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want
    assert all(math.isfinite(g.score) and g.score <= 0 for g in got)
    assert suffix_tree.score_documents(none).count() == 0


def test_link_filter(spark):
    pages = [(1, "http://WWW.example.com/en/1", None), (2, "https://a.example.com/en/", "x"), (3, "http://x.net/fr/2?q", ""), (4, "http://x.com", None), (5, None, None), (6, "no url", None), (7, "http://good.org/a", '<a href="http://bad.net/fr/">')]
    pages += [(10 + i, f"http://bad.net/fr/{i}", '<a href="//evil.org/">x</a>') for i in range(5)] + [(20 + i, "http://evil.org/x", '<A HREF="http://bad.net/es/">') for i in range(5)] + [(30, "http://bad.net/en", None)]
    got = {r.page_id: r for r in link_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block") and (got[3].path, got[3].rule) == ("/fr/2", "net/fr/")
    assert got[4].rule is None and got[4].path == "" and got[5].host == got[6].host == "" and got[6].verdict == "allow"
    assert got[20].verdict == "block" and got[30].verdict == "block"  # links to blocked pages, and a blocked host's other page
    assert link_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_line_rules(docs, rows, none):
    def repeats(w):
        hit = set()
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        for i, g in enumerate(grams):
            if grams.count(g) > 1:
                hit.update(range(i, i + 8))
        return len(hit)

    for _ in range(40):
        w = [RND.choice("ab") for _ in range(RND.randint(0, 30))]
        assert line_rules.repeated_words(w) == repeats(w)
    assert line_rules.base_metrics("a# b|\na# b|\n\n x y") == (5, 11, 4, 1, 0)
    got = {(r.doc_id, r.n_words) for r in line_rules.clean_documents(docs).collect()}
    assert got == {(r[0], len(words(r[1]))) for r in rows}
    assert line_rules.line_reason("Home | News | Login | More") == "navigation" and line_rules.line_reason("a### b%%% c$$$") == "symbols"
    assert line_rules.line_reason("\u00a0") == "punctuation" and line_rules.line_reason("home \u00a0") != "navigation"
    assert line_rules.line_reason("All rights reserved.") == "boilerplate" and line_rules.line_reason("an ordinary line of words.") is None
    assert line_rules.clean_documents(none).count() == 0


def test_simhash(docs, rows, none, spark):
    def fp(text):
        w = [x.lower() for x in words(text)]
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    base = rows + [(300 + i, rows[0][1] + f" tail{i}" * (i % 2), "en", "s0", 0, 0.5, 1) for i in range(12)]
    got = simhash.near_duplicates(spark.createDataFrame(base, SCHEMA), tile=8).collect()
    prints = [fp(r[1]) for r in base]
    group = list(range(len(base)))
    for i in range(len(base)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = Counter((r[0], f"{p:016x}", min((x[0] for x, h in zip(base, group) if h == g and x[0] is not None), default=None)) for r, p, g in zip(base, prints, group))
    assert Counter((g.doc_id, g.fingerprint, g.component_id) for g in got) == want
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted({g.component_id for g in simhash.near_duplicates(docs).collect() if g.component_id is not None})
    assert simhash.near_duplicates(none).count() == 0


def test_tile_forest_joins_all_links():
    rng = np.random.default_rng(1)
    x = np.unique(np.array([(1 << 40) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))], dtype=np.uint64))
    a, b = simhash.tile_forest(x, x, 2, True)
    assert len(a) < len(x) and set(a.tolist()) | set(b.tolist()) <= set(x.tolist())


def test_sharding(docs, rows, none):
    import zlib

    got = sharding.shard_documents(docs, n_shards=4).collect()
    data = lambda t: (t or "").encode()
    assert Counter((g.doc_id, g.size, g.text_crc32) for g in got) == Counter((r[0], len(data(r[1])) + 1, zlib.crc32(data(r[1]))) for r in rows)
    for s in range(4):
        slots = sorted(g.slot for g in got if g.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(none).count() == 0


def test_token_counts(docs, rows, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect())
    assert got == Counter((r[0], len(model.encode(r[1] or ""))) for r in rows)
    counter = token_counts.TokenCounter(open(path, "rb").read(), token_counts.whole_tokens(path))
    odd = ["".join(RND.choices(["a", " ", "  ", "\n", "▁", "é", "<s>", "\0", "🙂", ".\r", "hello"], k=RND.randint(0, 12))) for _ in range(2000)]
    assert counter(odd) == [len(x) for x in model.encode(odd)]
    assert token_counts.count_tokens(none, path).count() == 0


def test_mixing(docs, rows, none):
    got = mixing.mix_report(docs).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    assert sum({g.source_size: g.target for g in got}.values()) > 0 and all(g.taken in (0, g.size, 2 * g.size) for g in got)
    assert Counter((g.doc_id, g.taken) for g in got) == Counter((g.doc_id, g.taken) for g in mixing.mix_report(docs).collect())
    again = mixing.mix(docs)
    assert again.columns == docs.columns and sum(len(words(r.text)) for r in again.collect()) == sum(g.taken for g in got)
    assert mixing.mix_report(none).count() == 0


def test_chat_template(spark):
    turns = [(1, 1, "assistant", "b <turn x>\n</turn>\n \\"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, "assistant", "tie"), (None, 0, "assistant", "n")]
    talks = chat_template.with_control_case(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat_template.format_conversations(talks).collect()}
    said = "b <turn x>\n</turn>\n \\"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\n\nassistant\n{said}\n") and got[1].loss_sha256 == sha(said) and got[1].loss_chars == len(said)
    assert got[-7].n_turns == 2 and got[-7].loss_sha256 == sha(r"\### Assistant: </turn> ok")
    assert got[2].turns_sha256 == sha("\nx\nassistant\ntie\n") and None in got
    with pytest.raises(chat_template.TemplateError):
        chat_template.compile_template("{{ messages.__class__ }}")
    with pytest.raises(chat_template.TemplateError):  # valid, but its marks are unknown to the reader
        chat_template.format_conversations(talks, "{% for m in messages %}[{{ m.role }}] {{ m.text }}\n{% endfor %}")
    tree = chat_template.fold_block(chat_template.parse('a{% if "x" == "x" %}b{{ "c" + "d" | upper }}{% else %}no{% endif %}'))
    assert [n.value for n in tree] == ["abcD"]
