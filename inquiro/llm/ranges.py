"""Running sums within keys over sorted ranges, whatever share a key has.

Rows are range-partitioned by key and order, so that a large key spans several
ranges; each range is one sorted stream of Arrow batches that carries its sums
from batch to batch. Only the first key of a range may have begun before: its
rows take what the ranges before hold of it, of which there is a row a range.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from inquiro.llm.common import arrow_type, materialize


def _accumulated(values: np.ndarray, new: np.ndarray, carried: int, exclusive_or: bool) -> np.ndarray:
    """Running sums (or exclusive ors) that start anew where `new` is set;
    rows before the first start go on from `carried`."""
    run = np.bitwise_xor.accumulate(values) if exclusive_or else np.cumsum(values)
    starts = np.flatnonzero(new)
    before = np.concatenate([[np.int64(carried)], run[starts] ^ values[starts] if exclusive_or else run[starts] - values[starts]])
    base = before[np.cumsum(new)]
    if exclusive_or:
        return run ^ base
    base[np.cumsum(new) == 0] = -carried
    return run - base


def running(df: DataFrame, key: str, order: Sequence[Column], *, sums: Sequence[str] = (), xors: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """df without the columns `drop`, plus run_<c> for each long column c of
    sums and xors: its sum (exclusive or) over the rows of the same key up to
    this one. key is a long column without nulls; rows that tie in `order` may
    stand either way. Columns named _part, _first, _last must not exist."""
    names = [*sums, *xors]
    ranged = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).withColumn("_part", F.spark_partition_id())
    kept = [f for f in ranged.schema.fields if f.name not in drop]
    schema = StructType([*kept])
    for c in names:
        schema = schema.add(f"run_{c}", LongType())
    schema = schema.add("_first", BooleanType()).add("_last", BooleanType())
    types = [arrow_type(f.dataType) for f in schema]

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = at = None
        carried, held = [0] * len(names), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).to_numpy()
            first = keys[0] if first is None else first
            new = np.ones(n, bool)
            new[1:], new[0] = keys[1:] != keys[:-1], at is None or keys[0] != at
            runs = [_accumulated(batch.column(c).to_numpy(), new, carried[k], c in xors) for k, c in enumerate(names)]
            at, carried = keys[-1], [int(r[-1]) for r in runs]
            last = np.zeros(n, bool)
            columns = [*[batch.column(f.name) for f in kept], *[pa.array(r) for r in runs], pa.array(keys == first)]
            if held is not None:
                yield made(*held)
            held = (columns, last)
        if held is not None:
            held[1][-1] = True
            yield made(*held)

    def made(columns: list, last: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*columns, pa.array(last)], types, strict=True)], names=schema.names)

    out = materialize(ranged.mapInArrow(stream, schema))
    # one row a range; the sums of a key's ranges are handed to the range that follows
    upto = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = out.filter("_last").select(F.col(key).alias("_key"), "_part", F.lead("_part").over(Window.orderBy("_part")).alias("_next"), *[f"run_{c}" for c in names])
    handed = ends.select("_key", F.col("_next").alias("_part"), *[F.sum(f"run_{c}").over(upto).alias(f"_from_{c}") for c in sums], *[F.bit_xor(f"run_{c}").over(upto).alias(f"_from_{c}") for c in xors])
    joined = out.join(F.broadcast(handed), (out["_part"] == handed["_part"]) & (out[key] == handed["_key"]) & out["_first"], "left")
    added = [(F.col(f"run_{c}") + F.coalesce(f"_from_{c}", F.lit(0))).alias(f"run_{c}") for c in sums]
    added += [F.col(f"run_{c}").bitwiseXOR(F.coalesce(f"_from_{c}", F.lit(0))).alias(f"run_{c}") for c in xors]
    return joined.select(*[out[f.name] for f in kept if f.name != "_part"], *added)
