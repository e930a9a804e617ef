"""White space at the ends and inside, as the set of characters says."""

import re

from pyspark.sql import functions as F

from inquiro.functions import normalize as N


def test_spaces_of_all_kinds(spark):
    chars = [chr(k) for k in (*range(0, 0x300), 0x1680, 0x180E, *range(0x1FF0, 0x2070), 0x3000, 0x3001, 0xFEFF, 0x1F600)]
    texts = [t for c in chars for t in (c, f"{c}a{c}", f"a{c}b", f"a {c}b", f" {c} a{c}{c}b {c}")] + ["", "a  b", "a b", "  ", None, "x" * 50 + "  " + "y" * 50]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", N.strip(F.col("t")).alias("s"), N.trim(F.col("t")).alias("b"), N.whitespace(F.col("t")).alias("w"), N._single_spaced(F.col("t")).alias("o")).collect()
    ws = "[ \t\n\x0b\f\r\x1c-\x1f\x85\xa0  -     　]+"
    for r in rows:
        t = texts[r.k]
        s = None if t is None else re.sub(f"^{ws}|{ws}\\Z", "", t)
        assert r.s == s and r.b == s, (t, r.s, r.b)
        assert r.w == (None if t is None else re.sub(ws, " ", s)) and r.o == (None if t is None else re.sub(ws, " ", t)), (t, r.w)


def test_ends_are_found_without_a_search(spark):
    plan = spark.range(1).select(N.trim(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
