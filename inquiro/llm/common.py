"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from inquiro.storage import materialize, own_shuffles

__all__ = ["WORD", "arrow_type", "as_bytes", "lower_az", "materialize", "own_shuffles", "remainder_of_id", "share", "shared", "table", "text_slices"]

#: A word is a run of bytes other than ASCII space and the controls 9 to 13;
#: that is also how bytes.split() divides.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_type(kind: DataType) -> pa.DataType:
    """The Arrow type that Spark gives a column of this type."""
    return to_arrow_type(kind)


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a value of bounded size; objects of this package go by
    value, so executors need not have it installed."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(sent: Broadcast) -> object:
    return pickle.loads(sent.value)


def lower_az(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def remainder_of_id(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text at
    most (a longer single text stays whole); bounds the memory of a task."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
