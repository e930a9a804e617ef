"""Substring search by posting tables of letter groups.

Each item is listed under every pair and every three letters in a row of its
lowered texts. A search reads the postings of the groups of the text looked for
(of pairs where it has two letters), keeps the items that have all of them, and
only those are held against the text itself. Postings are stored by a hash of
the group, one folder a bucket, so a search reads as many folders as it has
groups, not the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
ROWS = 1_000_000  # postings that one task sorts and writes, about


def _groups(text: Column, n: int) -> Column:
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.substring(text, k, n))


def _bucket(group: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int")


def postings(items: DataFrame, *texts: Column, buckets: int = BUCKETS) -> DataFrame:
    """(letters, id, bucket): the letter groups of items' texts, each once an item."""
    lowered = F.transform(F.array_compact(F.array(*texts)), F.lower)
    groups = F.array_distinct(F.flatten(F.concat(F.transform(lowered, lambda t: _groups(t, 2)), F.transform(lowered, lambda t: _groups(t, 3)))))
    return items.select("id", F.explode(groups).alias("letters")).select("letters", "id", _bucket(F.col("letters"), buckets).alias("bucket"))


def write_index(items: DataFrame, path: str, *texts: Column, buckets: int = BUCKETS, rows_a_task: int = ROWS) -> None:
    """Replace the index at path by one of items(id, ...) over the texts. A
    group that most items have fills its bucket, so a bucket of more than
    `rows_a_task` postings is dealt by id into parts, each a file."""
    rows = postings(items, *texts, buckets=buckets)
    sizes = rows.groupBy("bucket").count().collect()  # at most a row a bucket
    parts = {r["bucket"]: -(-r["count"] // rows_a_task) for r in sizes if r["count"] > rows_a_task}
    spread = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])[F.col("bucket")] if parts else F.lit(1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce(spread, F.lit(1))))
    # so many tasks that each gets about one part of a large bucket
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * sum(parts.values()))
    rows.repartition(tasks, "bucket", "part").sortWithinPartitions("bucket", "letters").drop("part").write.mode("overwrite").partitionBy("bucket").parquet(path)


def candidates(spark: SparkSession, path: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(id) of the items that have all letter groups of a text of two letters
    or more: all that hold it, and maybe others."""
    lowered = text.lower()
    if len(lowered) < 2:
        raise ValueError("INVALID_QUERY")
    n = min(3, len(lowered))
    groups = sorted({lowered[k : k + n] for k in range(len(lowered) - n + 1)})
    wanted = spark.createDataFrame([(g,) for g in groups], "letters string").select("letters", _bucket(F.col("letters"), buckets).alias("bucket"))
    near = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # at most the letters of the text
    rows = spark.read.schema("letters string, id string, bucket int").parquet(path).filter(F.col("bucket").isin(near) & F.col("letters").isin(groups))
    return rows.groupBy("id").agg(F.count("*").alias("k")).filter(F.col("k") == len(groups)).select("id")
