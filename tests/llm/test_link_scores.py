"""Trust and distrust against PageRank by hand, and the defined cases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from inquiro.llm import link_filter


def by_hand(hosts, edges, damping=0.85, rounds=24):
    """hosts {host: (trusted, blocked)}, edges {(src, dst): w}; normalized
    trust and distrust after `rounds` steps."""
    out = {}
    for kind, turn in ((0, lambda e: e), (1, lambda e: e[::-1])):
        seeds = {h: s[kind] for h, s in hosts.items() if s[kind]}
        total = sum(seeds.values()) or 1
        seeds = {h: x / total for h, x in seeds.items()}
        flow = defaultdict(Counter)
        for e, w in edges.items():
            a, b = turn(e)
            flow[a][b] += w
        r = dict(seeds)
        for _ in range(rounds):
            new = Counter({h: (1 - damping) * x for h, x in seeds.items()})
            for a, x in r.items():
                for b, w in flow[a].items():
                    new[b] += damping * x * w / sum(flow[a].values())
            r = new
        whole = sum(r.values()) or 1
        out[kind] = {h: x / whole for h, x in r.items()}
    return {h: (out[0].get(h, 0.0), out[1].get(h, 0.0)) for h in hosts}


def test_scores_are_those_by_hand(spark):
    rnd = random.Random(6)
    hosts = {f"h{i}": (rnd.choice([0, 0, 3]), rnd.choice([0, 0, 2])) for i in range(30)}
    edges = {(a, b): rnd.randint(1, 4) for a, b in {(f"h{rnd.randrange(30)}", f"h{rnd.choice([0, rnd.randrange(30)])}") for _ in range(90)} if a != b}
    frame = spark.createDataFrame([(h, *s) for h, s in hosts.items()], "host string, trusted long, blocked long")
    got = link_filter.propagate(frame, spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, w long"), tolerance=0.0).collect()
    want = by_hand(hosts, edges)
    assert {r.host for r in got} == set(hosts)
    for r in got:
        assert (r.trust, r.distrust) == pytest.approx(want[r.host], abs=1e-9)


def test_verdicts_follow_the_scores(spark):
    """Whole query by hand: rules, seeds, families, threshold."""
    rnd = random.Random(9)
    pages = []
    for i in range(300):
        top, sub, lang = rnd.choice(["net", "org", "com"]), rnd.choice(["", "www.", "m."]), rnd.choice(["en", "es", "fr"])
        link = f'<p><a class="x" href="http://{rnd.choice("abcd")}.{rnd.choice(["net", "org"])}/y">z</a>' if rnd.random() < 0.4 else None
        pages.append((i, f"https://{sub}{rnd.choice('abcdef')}.{top}/{lang}/{i}?q#f", link))
    pages += [(7, pages[7][1], pages[7][2]), (None, "http://a.net/en", None), (301, None, "x"), (302, "none", None)]
    frame = spark.createDataFrame([(*p, 0.0, "x") for p in pages], "page_id long, url string, html string, trust double, verdict string")
    got = link_filter.judge_urls(frame, rounds=12).collect()
    assert len(got) == len(pages)

    def parts(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    def ruled(host, path):
        fits = [(len(t), t, v) for v, t in link_filter.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        return max(fits)[1:] if fits else (None, None)

    said, edges = defaultdict(Counter), Counter()
    for _, url, _ in pages:
        h, p = parts(url)
        said[h][ruled(h, p)[1]] += 1
    up = set()
    for h in said:
        while h.count(".") > 1:
            up.add((h, h.split(".", 1)[1]))
            h = h.split(".", 1)[1]
    for a, b in up:
        edges[a, b] += 1
        edges[b, a] += 1
    nodes = set(said) | {x for e in up for x in e}
    for _, url, html in pages:
        h = parts(url)[0]
        for to in re.findall(r'href="http://([^/"]+)', html or ""):
            if to != h and to in nodes:
                edges[h, to] += 1
    seeds = {h: (c["allow"] if c["allow"] > c["block"] else 0, c["block"] if c["block"] > c["allow"] else 0) for h, c in said.items()}
    seeds |= {h: (0, 0) for h in nodes - set(seeds)}
    score = by_hand(seeds, edges, rounds=12)
    floor = 1 / len(set(said) | {b for _, b in edges})
    want = []
    for i, url, _ in pages:
        h, p = parts(url)
        t, d = score[h]
        rule, v = ruled(h, p)
        want.append((i, h, p, rule, v or ("block" if d > t and d >= floor else "allow")))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=key) == sorted(want, key=key)
    free = Counter(w[4] for w in want if w[3] is None)
    assert free["block"] and free["allow"]
