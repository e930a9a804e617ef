"""Extraction and resolution."""

from pyspark.sql import functions as F

from inquiro.operators import extract, numbering, resolve


def spans(spark, text, names=(), doc_id="d1"):
    docs = spark.createDataFrame([(doc_id, text)], f"doc_id {'string' if isinstance(doc_id, str) else 'long'}, text string")
    return extract.extract_spans(docs, names).orderBy("start").collect()


def test_spans_do_not_overlap(spark):
    got = spans(spark, "Rahul Sharma called +91 98765 43210 on 2026-01-02 from DL01AB1234 via ACC-001", [("PERSON", "rahul sharma")])
    assert [r.type for r in got] == ["PERSON", "PHONE", "DATE", "VEHICLE", "ACCOUNT"] and got[0].doc_id == "d1"
    assert [(r.value, r.normalized_value, r.method, r.nlp_backend, r.span_id) for r in got[:2]] == [("Rahul Sharma", "rahul sharma", "gazetteer", "rules_only", "temp_001"), ("+919876543210", "+919876543210", "regex_phone", "rules_only", "temp_002")]


def test_longer_pattern_wins_and_unfit_matches_go(spark):
    assert [r.type for r in spans(spark, "DL01AB 2026-01-02T10:00")] == ["DATE"]
    assert spans(spark, "DL1A1234 and 2026-13-45") == [] and spans(spark, None, doc_id=4) == []
    got = spans(spark, "victim Ann Lee near St. Mary's Road", [("PERSON", "victim Ann Lee"), ("LOCATION", "st. mary's  road")])
    assert [(r.value, r.type, r.confidence) for r in got] == [("Ann Lee", "PERSON", 0.87), ("St. Mary's Road", "LOCATION", 0.85)]
    assert spans(spark, "x " * 150_000 + "+919876543210")[0].start == 300_000


def test_gazetteer(spark):
    docs = spark.createDataFrame([(1, "Rahul  Sharma met Anil in New Delhi."), (2, "rahul verma"), (3, None), (4, ""), (5, "Anil. Kumar"), (6, "St. Mary's Road"), (7, "a very long name of no less than eight words here"), (8, "xAnil")], "doc_id long, text string")
    listed = [("PERSON", "Rahul Sharma"), ("LOCATION", "New Delhi"), ("PERSON", "Anil"), ("PERSON", "Anil Kumar"), ("LOCATION", "st. mary's road"), ("PERSON", "very long name of no less than eight words"), ("PERSON", "..."), ("PERSON", "x" * 257)]
    got = {tuple(r) for r in extract.gazetteer_hits(docs, spark.createDataFrame(listed, "type string, name string")).collect()}
    assert got == {(1, *listed[0]), (1, *listed[1]), (1, *listed[2]), (5, *listed[2]), (6, *listed[4]), (7, *listed[5])}
    assert extract.gazetteer_hits(docs, spark.createDataFrame([], "type string, name string")).count() == 0
    entities = spark.createDataFrame([("p1", "PERSON", "Ann"), ("o1", "ORGANIZATION", "Acme"), ("l1", "LOCATION", "Pune"), ("v1", "VEHICLE", "X")], "id string, type string, name string")
    said = spark.createDataFrame([(f"m{k}", "p1", f"Ann {k}", k / 200) for k in range(150)] + [("z", "v1", "no", 1.0)], "id string, entity_id string, text string, confidence double")
    names = {tuple(r) for r in extract.build_gazetteer(entities, said).collect()}
    assert {("PERSON", "Ann"), ("PERSON", "Acme"), ("LOCATION", "Pune")} <= names and len(names) == 103 and ("PERSON", "Ann 149") in names and ("PERSON", "Ann 0") not in names


def test_numbers_run_through_ranges(spark):
    rows = [(k * 7919 % 1000, "ab"[k % 2]) for k in range(1000)]
    df = spark.createDataFrame(rows, "x long, t string").repartition(7)
    got = {r.x: r.n for r in numbering.numbered(df, "x").collect()}
    assert got == {x: k for k, x in enumerate(sorted(r[0] for r in rows), 1)}
    for t in "ab":
        own = sorted(r[0] for r in rows if r[1] == t)
        assert {r.x: r.n for r in numbering.numbered(df, "x", within="t").filter(F.col("t") == t).collect()} == {x: k for k, x in enumerate(own, 1)}


def said(spark, rows):
    return spark.createDataFrame([(d, k, t, v, v.lower() if t in ("PERSON", "ORGANIZATION", "LOCATION") else v, 0.9, "m") for k, (d, t, v) in enumerate(rows)], "document_id string, seq long, type string, value string, normalized_value string, confidence double, method string")


def test_fuzzy_needs_evidence(spark):
    rows = [(1, "PERSON", "Rahul Sharma", ["p1"]), (2, "PERSON", "Rahul S Sharma", ["p1"]), (3, "PERSON", "Rahul Sharmaa", ["p9"]), (4, "PERSON", "R", ["p1"])]
    got = resolve.fuzzy_matches(spark.createDataFrame(rows, "id long, type string, name string, evidence array<string>")).collect()
    assert [(r.id, r.into) for r in got] == [(2, 1)]


def test_all_matches_of_random_names(spark):
    import random
    from difflib import SequenceMatcher

    rnd = random.Random(1)
    rows = [(k, "PERSON", "".join(rnd.choices("abc", k=rnd.randint(1, 9))), [str(rnd.randrange(6)), str(rnd.randrange(6))]) for k in range(90)]
    got = {r.id: (r.into, r.similarity) for r in resolve.fuzzy_matches(spark.createDataFrame(rows, "id long, type string, name string, evidence array<string>")).collect()}
    want = {}
    for i, _, a, e in rows:
        fits = [(-s, j) for j, _, b, f in rows[:i] if set(e) & set(f) and (s := SequenceMatcher(None, a, b).ratio()) >= 0.65]
        if fits:
            want[i] = (min(fits)[1], -min(fits)[0])
    assert got == want


def test_batch_resolution(spark):
    rows = [
        ("d1", "PERSON", "Rahul Sharma"), ("d1", "PHONE", "+911"), ("d2", "PERSON", "Rahul S Sharma"), ("d2", "PHONE", "+911"), ("d2", "PHONE", "+912"),
        ("d3", "PERSON", "rahul sharma"), ("d4", "PERSON", "Rahul Sharmaa"), ("d4", "VEHICLE", "DL01AB1234"), ("d5", "DATE", "2026-01-01"), ("d5", "NONSENSE", "x"), ("d5", "PERSON", " "),
    ]
    resolved, entities = resolve.resolve_mentions(said(spark, rows))
    got = {r.seq: (r.canonical_id, r.resolution_method) for r in resolved.collect()}
    assert got == {
        0: ("person_001", ["new_entity"]), 1: ("phone_001", ["new_entity"]), 2: ("person_001", ["name_similarity", "phone_match"]), 3: ("phone_001", ["phone_match"]), 4: ("phone_002", ["new_entity"]),
        5: ("person_001", ["exact_match"]), 6: ("person_002", ["new_entity"]), 7: ("vehicle_001", ["new_entity"]), 8: ("date_001", ["new_entity"]),
    }
    conf = {r.seq: r.match_confidence for r in resolved.collect()}
    assert conf[3] == 0.97 and conf[5] == 1.0 and conf[2] == round(0.75 + 0.2 * (24 / 26), 2)
    kept = {r.id: r for r in entities.collect()}
    assert kept["person_001"].canonical_name == "Rahul Sharma" and [tuple(a) for a in kept["person_001"].attributes] == [("phones", "+911"), ("phones", "+912")]
    known = entities.withColumn("n", F.substring_index("id", "_", -1).cast("long"))
    later, all_ = resolve.resolve_mentions(said(spark, [("e1", "PERSON", "Rahul Sharma"), ("e2", "PERSON", "Rahul Sharna"), ("e2", "PHONE", "+912"), ("e3", "PERSON", "Zoe")]), known)
    assert [(r.seq, r.canonical_id, r.resolution_method[0]) for r in later.orderBy("seq").collect()] == [(0, "person_001", "exact_match"), (1, "person_001", "name_similarity"), (2, "phone_002", "phone_match"), (3, "person_003", "new_entity")]
    assert all_.count() == entities.count() + 1


def one_by_one(rows, threshold=0.65):
    """The rule, mention after mention: {seq: (entity, methods)}; and for
    each entity its identifiers."""
    from difflib import SequenceMatcher

    family = {"PHONE": "phones", "ACCOUNT": "accounts", "VEHICLE": "vehicles", "ORGANIZATION": "organizations"}
    strong = {"PHONE": "phone_match", "ACCOUNT": "account_match", "VEHICLE": "vehicle_match"}
    named, of_document, out = {}, {}, {}
    for d, t, v in rows:
        if t in family:
            of_document.setdefault(d, []).append((family[t], v.lower() if t == "ORGANIZATION" else v))
    counts, entities = {}, []  # [id, type, name, identifiers]
    for seq, (d, t, v) in enumerate(rows):
        name, mine = (v.lower() if t in ("PERSON", "ORGANIZATION", "LOCATION") else v), of_document.get(d, [])
        entity, methods = named.get((t, name)), [strong.get(t, "exact_match")]
        if entity is None and t in ("PERSON", "ORGANIZATION", "LOCATION"):
            best = 0.0
            for e in entities:
                alike = SequenceMatcher(None, name, e[2]).ratio()
                both = set(mine) & set(e[3])
                if e[1] == t and both and alike >= threshold and alike > best:
                    best, entity = alike, e
                    methods = ["name_similarity"] + [m for f, m in resolve.EVIDENCE.items() if f in {x for x, _ in both}]
        if entity is None:
            counts[t] = counts.get(t, 0) + 1
            entity, methods = [f"{resolve.PREFIX[t]}{counts[t]:03d}", t, name, []], ["new_entity"]
            entities.append(entity)
            named[t, name] = entity
        entity[3] += [x for x in dict.fromkeys(mine) if x not in entity[3]]
        out[seq] = (entity[0], methods)
    return out, {e[0]: e[3] for e in entities}


def test_resolution_equals_mention_by_mention(spark):
    """Chains, names that come back without evidence, identifiers gained late."""
    import random

    for seed in (3, 4):
        rng = random.Random(seed)
        rows = []
        for d in range(45):
            people = [("PERSON", "Ram" + "".join(rng.choices("aesh", k=rng.randrange(0, 4)))) for _ in range(rng.randrange(3))]
            marks = [("PHONE", f"+91{rng.randrange(7)}") for _ in range(rng.randrange(2))] + [("ORGANIZATION", rng.choice(["Acme Ltd", "ACME Ltd", "Acme Limited"]))] * rng.randrange(2)
            own = people + marks
            rng.shuffle(own)
            rows += [(f"d{d:02d}", *x) for x in own]
        resolved, entities = resolve.resolve_mentions(said(spark, rows))
        want, held = one_by_one(rows)
        assert {r.seq: (r.canonical_id, r.resolution_method) for r in resolved.collect()} == want
        assert {r.id: [tuple(a) for a in r.attributes or []] for r in entities.collect()} == held
        assert sum(m[0] == "name_similarity" for _, m in want.values()) > 5


def test_evidence_is_the_mentions_own(spark):
    """A name that joined by one document's phone is new in one without it."""
    rows = [("d1", "PERSON", "Rahul Sharma"), ("d1", "PHONE", "+911"), ("d2", "PERSON", "Rahul Sharmaa"), ("d2", "PHONE", "+911"), ("d3", "PERSON", "Rahul Sharmaa"), ("d4", "PERSON", "Rahul Sharmaa"), ("d4", "PHONE", "+911")]
    got = {r.seq: (r.canonical_id, r.resolution_method[0]) for r in resolve.resolve_mentions(said(spark, rows))[0].collect()}
    assert got[2] == ("person_001", "name_similarity") and got[4] == ("person_002", "new_entity") and got[5] == ("person_002", "exact_match")


def test_mentions_after_their_entity_are_not_judged_again(spark, monkeypatch):
    """A wave judges names' first mentions and open ones, however often a name is said."""
    rows = [(f"d{k:02d}", *x) for k in range(30) for x in (("PERSON", "Rahul Sharma" if k != 4 else "Rahul Sharmaa"), ("PHONE", "+911"))]
    judged, judge = [], resolve._judged
    monkeypatch.setattr(resolve, "_judged", lambda rest, *a: judged.append(rest.count()) or judge(rest, *a))
    got = {r.seq: r.canonical_id for r in resolve.resolve_mentions(said(spark, rows))[0].collect()}
    assert max(judged) == 2 and {got[2 * k] for k in range(30)} == {"person_001"}
