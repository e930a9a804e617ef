"""A full bucket of postings is written in parts."""

from pathlib import Path

from pyspark.sql import functions as F

from inquiro.operators import index


def test_full_buckets_go_in_parts(spark, tmp_path):
    items = spark.range(600).select(F.concat(F.lit("common"), F.col("id").cast("string")).alias("id"))
    path = tmp_path / "grams"
    index.write_index(items, str(path), F.col("id"), buckets=2, rows_a_task=500)
    rows = spark.read.parquet(str(path)).withColumn("file", F.input_file_name())
    assert max(r["count"] for r in rows.groupBy("file").count().collect()) < 4000 < rows.count() / 2
    assert len(list(Path(path).glob("bucket=*/*.parquet"))) > 4
    assert index.candidates(spark, str(path), "common", buckets=2).count() == 600
