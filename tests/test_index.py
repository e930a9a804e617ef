"""Substring search: the rows of a scan, from matching postings alone."""

import random

import pytest
from pyspark.sql import functions as F

from inquiro.operators import index, reads


def test_search_equals_a_scan(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"id{k}", "".join(rng.choices("abcÄ 1.", k=rng.randrange(0, 9))), None if k % 5 == 0 else [("".join(rng.choices("abC", k=4)))]) for k in range(300)]
    items = spark.createDataFrame([(i, "PERSON", n, a) for i, n, a in rows], "id string, type string, name string, aliases array<string>").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    path = str(tmp_path / "grams")
    index.write_index(items, path, F.col("name"), F.col("id"), F.array_join("aliases", "\n"), buckets=16)
    for q in ["ab", "ABC", "c ä", "id29", "1.", "zzz", "aaaa", "Ä1", "bcab"]:
        found = index.candidates(spark, path, q, buckets=16)
        want = {tuple(r) for r in reads.search(items, q).collect()}
        assert {tuple(r) for r in reads.search(items.join(found, "id", "left_semi"), q).collect()} == want, q
        assert {r.id for r in found.collect()} >= {r[0] for r in want}
    plan = index.candidates(spark, path, "abc", buckets=16)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    with pytest.raises(ValueError):
        index.candidates(spark, path, "a")


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "none")
    items = spark.createDataFrame([("a", None), ("b", "x")], "id string, name string")
    index.write_index(items, path, F.col("name"), buckets=4)
    assert index.candidates(spark, path, "xy", buckets=4).count() == 0
