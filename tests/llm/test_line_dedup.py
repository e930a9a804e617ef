"""Repeated lines against brute force: hot keys over many ranges and batches."""

import hashlib
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from inquiro.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


@contextmanager
def ranges(spark, batch):
    """Ranges stay apart and Arrow batches small, so keys cross both."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    """Per row (id, n_lines, n_dropped, digest); a null id is below all."""
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(doc)
    keeper = {k: max(v, key=lambda d: (d is not None, d)) for k, v in holders.items() if len(v) >= 3}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def report(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in line_dedup.line_report(docs).collect()), key=str)


@pytest.mark.parametrize("batch", [2, 5, 10_000])
def test_against_brute_force(spark, batch):
    rng = random.Random(batch)
    common = [f"line number {k} that many documents hold" for k in range(6)] + ["Kürze — zwanzig Zeichen", "Kürze: neunzehn Ze.", "short", ""]
    rows = []
    for d in range(120):
        lines = [rng.choice(common[: 1 + d % 10]) for _ in range(rng.randrange(6))] + [f"a line of document {d} alone, long enough"]
        rng.shuffle(lines)
        rows.append((d * 3, "\n".join(rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.3 and x.isascii() else x) + rng.choice(["", "\r", "  "]) for x in lines)))
    with ranges(spark, batch):
        assert report(spark, rows) == brute(rows)


@pytest.mark.parametrize("batch", [1, 3])
def test_one_key_over_all_ranges(spark, batch):
    rows = [(d, "the one line that every document holds\n" * (1 + d % 3) + ("x" * 30 + str(d))) for d in range(60)]
    with ranges(spark, batch):
        assert report(spark, rows) == brute(rows)


def test_thresholds(spark):
    twenty, nineteen = "é" * 20, "é" * 19
    rows = [(1, twenty), (2, twenty), (3, twenty + "\n" + twenty), (4, nineteen), (5, nineteen), (6, nineteen), (7, "two documents hold this line"), (8, "two documents hold this line")]
    got = {r[0]: r[2] for r in report(spark, rows)}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}


def test_defined_cases(spark):
    line = "a line that is held by several rows"
    rows = [(None, line), (None, line), (1, None), (1, ""), (2, line), (2, line), (2, f"{line}\nand another text"), (3, f"{line}\n\n{line}"), (4, "\n\n")]
    assert report(spark, rows) == brute(rows)
    assert report(spark, []) == []
    long = "\n".join([f"row {k % 50} of a very long text with repeats" for k in range(20_000)])
    assert report(spark, [(1, long), (2, long), (3, long)]) == brute([(1, long), (2, long), (3, long)])


def test_bitmaps_and_texts(spark):
    shared = "the line that three documents share"
    rows = [(1, f"{shared}\nfirst", 7), (2, f"second\n{shared}\nend", 8), (3, shared, 9), (4, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep int").withColumn("n_lines", F.lit("x")).withColumn("part", F.col("keep"))
    maps = {r.doc_id: line_dedup.unpack(bytes(r.keep), r.n_lines).tolist() for r in line_dedup.keep_bitmaps(docs).collect()}
    assert maps == {1: [False, True], 2: [True, False, True]}
    clean = line_dedup.clean_documents(docs)
    assert clean.columns == docs.columns and clean.schema == docs.schema
    assert {(r.doc_id, r.text, r.keep, r.n_lines) for r in clean.collect()} == {(1, "first", 7, "x"), (2, "second\nend", 8, "x"), (3, shared, 9, "x"), (4, None, 1, "x")}
    with pytest.raises(ValueError, match="2 or more"):
        line_dedup.dropped_lines(docs, least_documents=1)
