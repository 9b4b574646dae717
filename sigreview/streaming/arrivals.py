"""Arrivals told apart in one stateful query: kept, repeated, late, untimed.

The state of a key is the time until which it is remembered.  Keys are dealt into buckets by their hash, and
a bucket's rows and state are taken together, so Python's and the state store's cost goes by bucket and not by
key.  An event-time timer at the bucket's earliest time ends what is due, so state holds the keys of one delay
only.  The watermark that decides what is late is the query's own, read where the rows are judged; no
second stream has to agree with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BinaryType, DoubleType, FloatType, StringType, StructField, StructType, TimestampType

from ..schemas import READING_CURSOR, READING_KEY

KEPT, REPEATED, LATE, UNTIMED = "kept", "repeated", "late", "untimed"

# Columns of the processor's own; names with a leading underscore would not reach it.
_OWN = ["arrival_bucket", "arrival_name", "arrival_ms", "arrival_until", "arrival_tie"]

# Buckets of keys: a few milliseconds each in a micro-batch, whatever is in them.  A checkpoint keeps its number.
BUCKETS = 1024

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstArrivals(StatefulProcessor):
    """Labels the rows of a bucket of keys; remembers each key until its first arrival's time plus the delay."""

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "names binary, due long")

    def _read(self) -> tuple[dict[str, int], int | None]:
        """The bucket's keys with the times until which they are remembered, and when its timer is due."""
        state = self.known.get()
        if state is None:
            return {}, None
        table = pa.ipc.open_stream(bytes(state[0])).read_all()
        return dict(zip(table.column("name").to_pylist(), table.column("until").to_pylist())), state[1]

    def _write(self, known: dict[str, int], due: int | None) -> None:
        """Keep the bucket's keys, with one timer at the earliest time; an empty bucket leaves nothing."""
        if not known:
            self.known.clear()
            return
        table = pa.table({"name": pa.array(list(known), pa.large_string()), "until": pa.array(list(known.values()), pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        earliest = min(known.values())
        self.known.update((sink.getvalue().to_pybytes(), earliest))
        if earliest != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(earliest)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        known, due = self._read()
        whole, label, kept = None, None, []
        for batch in rows:
            if not len(batch):
                continue
            if whole is not None:
                # The first ones so far wait for what else comes.
                done = np.ones(len(whole), bool)
                done[kept] = False
                if not done.all():
                    batch = pd.concat([whole[~done], batch])
                if done.any():
                    yield whole[done].drop(columns=_OWN).assign(arrival=label[done])
            whole = batch
            ms = whole["arrival_ms"].to_numpy(dtype="float64", na_value=np.nan)
            label = np.where(np.isnan(ms), UNTIMED, np.where((ms <= mark) & (mark > 0), LATE, REPEATED)).astype(object)
            # Of a key's rows in one micro-batch the earliest counts.
            names, ties, first = whole["arrival_name"].tolist(), whole["arrival_tie"].tolist(), {}
            for i in np.flatnonzero(label == REPEATED).tolist():
                if names[i] not in known:
                    k = first.setdefault(names[i], i)
                    if (ms[i], ties[i]) < (ms[k], ties[k]):
                        first[names[i]] = i
            kept = list(first.values())
        if whole is None:
            return
        if kept:
            label[kept] = KEPT
            known.update(zip(first, whole["arrival_until"].iloc[kept].astype("int64").tolist()))
            self._write(known, due)
        yield whole.drop(columns=_OWN).assign(arrival=label)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        known, _ = self._read()
        self._write({name: until for name, until in known.items() if until > mark}, None)
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which timers need; the session's setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _text(field: StructField) -> str:
    """SQL for a key's column as text that differs where, and only where, grouping by the column tells values apart."""
    name = f"`{field.name.replace('`', '``')}`"
    if isinstance(field.dataType, BinaryType):
        return f"hex({name})"
    if isinstance(field.dataType, TimestampType):
        return f"CAST(unix_micros({name}) AS STRING)"
    if isinstance(field.dataType, (FloatType, DoubleType)):
        return f"CAST(CASE WHEN {name} = 0 THEN 0 ELSE {name} END AS STRING)"
    return f"CAST({name} AS STRING)"


def label_arrivals(
    readings: DataFrame, delay: str = "1 day", key: Sequence[str] = READING_KEY, cursor: str = READING_CURSOR,
    buckets: int = BUCKETS,
) -> DataFrame:
    """A stream's rows with ``arrival``: every row comes out once.

    ``late`` is a row whose time is ``delay`` or more before the newest one of earlier micro-batches;
    ``untimed`` one without a time; ``kept`` the first arrival of its key (of several in one micro-batch the earliest,
    ties by a hash of the row), ``repeated`` any other one until the first one's time plus ``delay`` has passed.
    Late and untimed rows leave no state.  Start the result within :func:`state_in_rocksdb`.
    Keys are dealt into ``buckets``, a number that a checkpoint keeps; a micro-batch rewrites the state of the
    buckets that get new keys.
    """
    instant = f"CAST({cursor} AS TIMESTAMP)"
    timed = readings.withColumn("_event_time", F.expr(instant)).withWatermark("_event_time", delay)
    name = f"to_json(array({', '.join(_text(readings.schema[k]) for k in key)}))"
    # The watermark's column ends here: with it Spark would drop late rows before they are judged.
    judged = timed.selectExpr(
        *readings.columns, f"CAST(pmod(xxhash64({name}), {buckets}) AS INT) AS arrival_bucket", f"{name} AS arrival_name",
        f"unix_millis({instant}) AS arrival_ms", f"unix_millis({instant} + INTERVAL {delay}) AS arrival_until",
        f"xxhash64({', '.join(readings.columns)}) AS arrival_tie")
    out = StructType([*(StructField(f.name, f.dataType) for f in readings.schema), StructField("arrival", StringType())])
    return judged.groupBy("arrival_bucket").transformWithStateInPandas(FirstArrivals(), out, "Append", "eventTime")


def start_arrivals(
    readings: DataFrame, path: str, checkpoint: str, delay: str = "1 day", key: Sequence[str] = READING_KEY,
    cursor: str = READING_CURSOR, buckets: int = BUCKETS, **trigger,
) -> StreamingQuery:
    """Append the labelled rows to a Parquet folder partitioned by ``arrival``, so each kind is read alone."""
    labelled = label_arrivals(readings, delay, key, cursor, buckets)
    writer = labelled.writeStream.format("parquet").option("path", path).partitionBy("arrival")
    with state_in_rocksdb(readings.sparkSession):
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
