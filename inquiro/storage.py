"""Where intermediate tables go: one place that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Frames made under this setting drop their shuffle files when their query ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """For queries that are run once within: their shuffle files go at their
    end. Build and run them inside, and never run one of these frames again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which all executors share.

    Where the setting is absent, a session on one machine (master local[..])
    takes a temporary folder. On a cluster such a folder would be another one
    on each machine and lose rows without a word, so there it is refused.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(SETTING, base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it back: the lineage ends
    there, a lost executor costs no recomputation, and several readers
    share one run. The write's own shuffle files go with it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with own_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
