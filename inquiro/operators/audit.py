"""Hash-chained audit logs: canonical digests, appending and verification.

A chain is sequential by its rule: each hash covers the one before. Appending is
thus one sorted stream a log, which holds one hash; logs run apart. In a stream
of events the head of each log is state, so that after a restart the chain goes on
from what was committed and a replayed batch gives the same rows again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

GENESIS = "GENESIS"
FIELDS = ("action", "actor", "created_at", "input_hash", "output_hash", "prev_hash", "target")
# JSON's short escapes.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_text(c: Column) -> Column:
    """A JSON string in ASCII alone, quotes included."""
    def one(x: Column) -> Column:
        code = F.lower(F.regexp_replace(F.hex(F.encode(x, "UTF-16BE")), "(.{4})", r"\\u$1"))
        out = F.when(x.rlike(r"^[\x20-\x7e]$"), x).otherwise(code)
        for k, v in _SHORT.items():
            out = F.when(x == F.lit(k), F.lit(v)).otherwise(out)
        return out

    plain = c.rlike(r'^[\x20\x21\x23-\x5b\x5d-\x7e]*$')
    escaped = F.array_join(F.transform(F.split(c, ""), one), "")
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(escaped), F.lit('"'))


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object of text fields: keys in order, no spaces, ASCII alone."""
    parts = [F.concat(F.lit(f'"{k}":'), json_text(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def digest(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def event_hash(fields: dict[str, Column]) -> Column:
    """The chain hash of an event: over the hash before and its fields."""
    full = {k: F.coalesce(fields.get(k, F.lit("")), F.lit("")) for k in FIELDS}
    return F.sha2(F.concat(full["prev_hash"], canonical_json(full)), 256)


def linked_hash(prev_hash: str, event: dict[str, str | None]) -> str:
    """event_hash() of one event, for the writer's stream."""
    full = {k: prev_hash if k == "prev_hash" else event.get(k) or "" for k in FIELDS}
    return hashlib.sha256((prev_hash + json.dumps(full, sort_keys=True, separators=(",", ":"))).encode()).hexdigest()


_GIVEN = tuple(f for f in FIELDS if f != "prev_hash")


def _chained_schema(events: StructType) -> StructType:
    return StructType([*events.fields, StructField("prev_hash", StringType()), StructField("hash", StringType())])


def append_events(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """events(log, seq, and FIELDS without prev_hash as text) with prev_hash
    and hash: each log in order of seq from its head, of heads(log, head),
    or from GENESIS."""
    names = events.columns
    if heads is not None:
        events = events.join(heads.select("log", F.col("head").alias("_head")), "log", "left").select(*names, "_head")
    else:
        events = events.withColumn("_head", F.lit(None).cast("string"))
    schema = _chained_schema(events.drop("_head").schema)
    arrow = to_arrow_schema(schema)

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, head = object(), None
        for batch in batches:
            rows = zip(batch.column("log").to_pylist(), batch.column("_head").to_pylist(), *[batch.column(f).to_pylist() for f in _GIVEN], strict=True)
            before, after = [], []
            for own, start, *values in rows:
                if own != log:
                    log, head = own, start or GENESIS
                before.append(head)
                head = linked_hash(head, dict(zip(_GIVEN, values, strict=True)))
                after.append(head)
            columns = [*[batch.column(c) for c in names], pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return events.repartition("log").sortWithinPartitions("log", "seq").mapInArrow(chain, schema)


def append_stream(events: DataFrame) -> DataFrame:
    """append_events() over a stream of events, with the head of each log as
    state. Within a micro-batch a log's events go by seq; the batch's events of
    a log are held together, so the trigger bounds the memory."""
    schema = _chained_schema(events.schema)
    names = events.columns

    def chain(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head = state.get[0] if state.exists else GENESIS
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        before, after = [], []
        for values in rows[list(_GIVEN)].itertuples(index=False):
            before.append(head)
            head = linked_hash(head, {k: v if isinstance(v, str) else None for k, v in zip(_GIVEN, values, strict=True)})
            after.append(head)
        state.update((head,))
        yield rows[names].assign(prev_hash=before, hash=after)

    return events.groupBy("log").applyInPandasWithState(chain, schema, "head string", "append", GroupStateTimeout.NoTimeout)


def heads_of(chained: DataFrame) -> DataFrame:
    """(log, head): the last hash of each log."""
    return chained.groupBy("log").agg(F.max_by("hash", "seq").alias("head"))


def check_rows(log: DataFrame, span: int = 100_000) -> DataFrame:
    """(seq, id, hash, ok): each row's own hash and its link to the row before.

    A row's own hash is found where it lies; only that verdict, the id and the
    two hashes are dealt. With a column `log` rows are dealt by log once, and
    each log is read in order of seq, as its writer wrote it. Without one the
    order is cut into spans of `span` sequence numbers; a span's first row takes
    the last hash of the nearest span before that holds rows, so no task sorts
    more than a span (or one row a span)."""
    have = {k: F.col(k) for k in FIELDS if k in log.columns}
    own = ["log"] if "log" in log.columns else []
    log = log.select(*own, "seq", "id", "hash", "prev_hash", (F.col("hash") == event_hash(have)).alias("whole"))
    if own:
        linked = log.withColumn("expected", F.coalesce(F.lag("hash").over(Window.partitionBy("log").orderBy("seq")), F.lit(GENESIS)))
    else:
        log = log.withColumn("b", F.floor(F.col("seq") / span))
        last = log.groupBy("b").agg(F.max_by("hash", "seq").alias("last"))
        carried = last.select("b", F.lag("last").over(Window.orderBy("b")).alias("carried"))
        inside = log.withColumn("before", F.lag("hash").over(Window.partitionBy("b").orderBy("seq")))
        linked = inside.join(carried, "b").withColumn("expected", F.coalesce("before", "carried", F.lit(GENESIS)))
    good = (F.col("prev_hash") == F.col("expected")) & F.col("whole")
    return linked.select(*own, "seq", "id", "hash", F.coalesce(good, F.lit(False)).alias("ok"))


def _verdict() -> list[Column]:
    bad = F.when(~F.col("ok"), F.col("seq"))
    return [F.coalesce(F.bool_and("ok"), F.lit(True)).alias("verified"), F.count("*").alias("count"), F.max_by("hash", "seq").alias("head_hash"), F.min_by("id", bad).alias("broken_at")]


def verify_chain(log: DataFrame, span: int = 100_000) -> DataFrame:
    """One row: verified, count, head_hash and broken_at (the first bad id)."""
    return check_rows(log, span).agg(*_verdict())


def verify_logs(logs: DataFrame, span: int = 100_000) -> DataFrame:
    """verify_chain() of each log."""
    return check_rows(logs, span).groupBy("log").agg(*_verdict())
