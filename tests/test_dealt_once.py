"""Logs are dealt once for their check."""

from pyspark.sql import functions as F

from inquiro.operators import audit


def test_logs_are_dealt_once(spark):
    fields = ("id", "created_at", "actor", "action", "target", "input_hash", "output_hash")
    rows = [(log, 1000 * k + log, *(f"{f}{k}" for f in fields)) for log in range(5) for k in range(9)]  # each row in a span of its own
    made = audit.append_events(spark.createDataFrame(rows, "log long, seq long, " + ", ".join(f"{f} string" for f in fields))).localCheckpoint()
    touched = made.withColumn("actor", F.when((F.col("log") == 3) & (F.col("seq") == 4003), "x").otherwise(F.col("actor")))
    checked = audit.verify_logs(touched, 100)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert {(r.log, r.verified, r["count"], r.broken_at) for r in checked.collect()} == {(k, k != 3, 9, None if k != 3 else "id4") for k in range(5)}
    gone = audit.verify_logs(made.filter("seq <> 4003"), 100).filter("log = 3").first()
    assert (gone.verified, gone["count"], gone.broken_at) == (False, 8, "id5")
