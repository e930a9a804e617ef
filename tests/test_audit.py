"""The audit chain: valid, tampered, with gaps."""

import hashlib
import json

from pyspark.sql import functions as F

from inquiro.operators import audit

TEXTS = ["login", 'say "hi"\\ \n\t', "naïve — 🙂", "", "\x01\x1f\x7f", "plain"]


def chain(n, step=1):
    rows, prev = [], audit.GENESIS
    for k in range(n):
        f = {"prev_hash": prev, "created_at": f"2026-01-01T00:00:{k:02d}Z", "actor": f"a{k}", "action": TEXTS[k % len(TEXTS)], "target": TEXTS[-k % len(TEXTS)], "input_hash": "", "output_hash": f"{k}"}
        own = hashlib.sha256((prev + json.dumps(f, sort_keys=True, separators=(",", ":"))).encode()).hexdigest()
        rows.append((k * step, f"audit_{k}", *(f[x] for x in audit.FIELDS), own))
        prev = own
    return rows


SCHEMA = "seq long, id string, " + ", ".join(f"{f} string" for f in audit.FIELDS) + ", hash string"


def verdict(spark, rows, span=5):
    return tuple(audit.verify_chain(spark.createDataFrame(rows, SCHEMA), span).first())


def test_valid_chains(spark):
    for step in (1, 13):  # with spans that hold no row
        rows = chain(12, step)
        assert verdict(spark, rows) == (True, 12, rows[-1][-1], None)
    assert verdict(spark, []) == (True, 0, None, None)


def test_broken_chains(spark):
    rows = chain(12)
    changed = [(*r[:3], "someone", *r[4:]) if k == 4 else r for k, r in enumerate(rows)]
    assert verdict(spark, changed)[0] is False and verdict(spark, changed)[3] == "audit_4"
    assert verdict(spark, rows[:6] + rows[7:])[3] == "audit_7" and verdict(spark, rows[1:])[3] == "audit_1"


def test_digest(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "b string").select(audit.digest({"b": F.col("b"), "a": F.lit("x")}).alias("d"), "b").collect()
    assert all(r.d == hashlib.sha256(json.dumps({"a": "x", "b": r.b}, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for r in got)


EVENTS = "log string, seq long, id string, created_at string, actor string, action string, target string, input_hash string, output_hash string"


def events(rows):
    return [(log, seq, f"{log}{seq}", f"2026-01-{seq % 28 + 1:02d}", None if seq % 5 == 0 else f"ä{seq}", TEXTS[seq % len(TEXTS)], "t", "", f"{seq}") for log, seq in rows]


def test_appended_chains_verify(spark):
    rows = events([(log, k) for log in "ab" for k in range(30)] + [("c", 4)])
    made = audit.append_events(spark.createDataFrame(rows, EVENTS).repartition(5))
    got = {r.log: r for r in audit.verify_logs(made, 7).collect()}
    assert {k: (r.verified, r["count"], r.broken_at) for k, r in got.items()} == {"a": (True, 30, None), "b": (True, 30, None), "c": (True, 1, None)}
    assert tuple(audit.verify_chain(made.filter("log = 'a'").drop("log"), 7).first())[:2] == (True, 30)
    # in two parts, the second from the heads of the first
    one = audit.append_events(spark.createDataFrame([r for r in rows if r[1] < 11], EVENTS))
    two = audit.append_events(spark.createDataFrame([r for r in rows if r[1] >= 11], EVENTS), audit.heads_of(one))
    assert sorted(map(tuple, one.unionByName(two).collect())) == sorted(map(tuple, made.collect()))
    changed = made.withColumn("actor", F.when((F.col("log") == "b") & (F.col("seq") == 12), "someone").otherwise(F.col("actor")))
    assert {r.log: r.broken_at for r in audit.verify_logs(changed, 7).collect()} == {"a": None, "b": "b12", "c": None}
    assert audit.append_events(spark.createDataFrame([], EVENTS)).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """Batches in several runs give one chain; a run without news adds nothing."""
    rows = events([(log, k) for log in "ab" for k in range(24)])
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        audit.append_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for low in (0, 8, 16):
        spark.createDataFrame([r for r in rows if low <= r[1] < low + 8], EVENTS).coalesce(1).write.mode("append").parquet(source)
        run()
    run()
    made = spark.read.parquet(out)
    assert made.count() == 48 and {r.log: (r.verified, r["count"]) for r in audit.verify_logs(made, 5).collect()} == {"a": (True, 24), "b": (True, 24)}
    want = audit.append_events(spark.createDataFrame(rows, EVENTS))
    assert {(r.id, r.hash) for r in made.collect()} == {(r.id, r.hash) for r in want.collect()}
