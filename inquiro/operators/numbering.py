"""Running numbers without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inquiro.storage import materialize


def numbered(df: DataFrame, *order: str | Column, within: str | None = None, name: str = "n") -> DataFrame:
    """df with `name`: 1, 2, ... in the given order (within each value of a
    column, if one is given). Rows are dealt by sampled ranges of the order;
    each range is numbered by itself and shifted by the counts before it, of
    which there is one a range and value."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    own = [within] if within else []
    ranged = materialize(df.repartitionByRange(*own, *keys).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range", *own).agg(F.count("*").alias("_k"))
    before = Window.partitionBy(*own).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_range", *own, F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", *own).orderBy(*keys)
    out = ranged.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(shift), ["_range", *own])
    return out.select(*df.columns, (F.col("_before") + F.col("_row")).cast("long").alias(name))


def cumulative_below(values: DataFrame, value: str, count: str, by: str) -> DataFrame:
    """values(by, value, count) with `below`: the counts of smaller values of
    the same `by`, by ranges as above."""
    ranged = materialize(values.repartitionByRange(by, value).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range", by).agg(F.sum(count).alias("_k"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("_range", by, F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_in", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(F.broadcast(shift), ["_range", by])
    return out.select(*values.columns, (F.col("_before") + F.col("_in")).alias("below"))
