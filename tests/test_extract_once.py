"""Pattern matches and their normal forms are made once a text."""

from pyspark.sql import functions as F

from inquiro.operators import extract


def test_filters_read_normal_forms(spark):
    texts = ["On 2024-02-30 and 2024-02-28 a call from +91 98765 43210, DL-1 AB 1234 and dl 01 ab 1234, ACC-1234.", "nothing", None, ""]
    found = extract.extract_values(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter((F.btrim("value") != "") & (F.length("value") < 99))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    steps = [line for line in plan.splitlines() if "regexp" in line]
    assert len(steps) == 1 and "Generate" in steps[0]
    assert found.columns == ["doc_id", "type", "raw", "value", "confidence"]
    rows = {(r.doc_id, r.type, r.value, r.confidence) for r in found.collect()}
    assert rows == {(0, "DATE", "2024-02-28", 0.9), (0, "PHONE", "+919876543210", 0.97), (0, "VEHICLE", "DL01AB1234", 0.97), (0, "ACCOUNT", "ACC1234", 0.97)}
