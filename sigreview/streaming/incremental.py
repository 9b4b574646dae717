"""Incremental forms: read what landed, drop repeats, score, sync, count.

``score_stream`` scores against a static history; with ``start_scores`` the history moves with the
stream.  ``arrivals.py`` tells repeats and late rows apart, ``batch_log.py`` keeps what micro-batches append.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.review_queue import merge_queue, queue_source
from ..operators.scoring import PARTIAL, history_of_parts, history_parts, merge_parts, score_readings
from ..schemas import QUEUE, QUEUE_KEY, READING_CURSOR, READING_KEY
from ..session import names_in, pinned
from ..sources.envelope import ingest_readings, parse_pages
from ..sources.lines import stream_lines
from .batch_log import BatchLog, latest_per_key


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Newly landed page files (one JSON page per line) as parsed pages; ``lines.start_landing`` keeps rejects too."""
    return parse_pages(stream_lines(spark, path, files_per_trigger))


def stream_readings(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return ingest_readings(stream_pages(spark, path, files_per_trigger))


def drop_repeats(
    readings: DataFrame,
    delay: str = "1 day",
    key: Sequence[str] = READING_KEY,
    cursor: str = READING_CURSOR,
) -> DataFrame:
    """First arrival per declared key; state is kept for the watermark delay only.

    A watermark needs an instant, so the wall-clock cursor is read in the
    session time zone for it.  What comes later than the delay is left out here;
    ``arrivals.label_arrivals`` keeps it.
    """
    timed = readings.withColumn("_event_time", F.col(cursor).cast("timestamp"))
    once = timed.withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(list(key))
    return once.drop("_event_time")


def score_stream(
    readings: DataFrame, reference: DataFrame, past: DataFrame, as_of: datetime
) -> DataFrame:
    """Verdicts for new readings against a static reference and history."""
    return score_readings(readings, reference, as_of, past)


def start_append(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the stream to a Parquet folder (by default all that is there, then stop)."""
    writer = df.writeStream.format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def scores_root(root: str) -> str:
    return f"{root.rstrip('/')}/flags"


def history_log(spark: SparkSession, root: str, every: int = 16) -> BatchLog:
    """The moving history under ``root``, as mergeable sums per pair and micro-batch."""
    return BatchLog(spark, f"{root.rstrip('/')}/history", PARTIAL, merge_parts, every)


def latest_history(spark: SparkSession, root: str) -> DataFrame:
    """The history of all readings scored so far."""
    return history_of_parts(history_log(spark, root).now())


def start_scores(
    readings: DataFrame, reference: DataFrame, as_of: datetime, root: str, checkpoint: str,
    initial: DataFrame | None = None, every: int = 16, **trigger,
) -> StreamingQuery:
    """Score each micro-batch against the history of all earlier ones, then add it to that history.

    ``initial`` (columns of ``PARTIAL``) is what was known before the stream.  Scores go to :func:`scores_root`
    and sums to the history, both by batch; a replayed batch sees the history of the batches
    before it, as at first, and writes the same again.
    """
    log = history_log(readings.sparkSession, root, every)
    if initial is not None:
        log.start(initial)
    pair = ["compound_id", "assay_name"]

    def score(batch: DataFrame, batch_id: int) -> None:
        log.compact(batch_id)
        with pinned(batch) as rows:
            # Only pairs that occur in the batch are looked up.
            known = log.rows(batch_id - 1).join(rows.select(*pair).distinct(), pair, "left_semi")
            flags = score_readings(rows, reference, as_of, history_of_parts(log.fold(known)))
            flags.write.mode("overwrite").parquet(_snapshot(scores_root(root), batch_id))
            log.append(history_parts(rows), batch_id)

    writer = readings.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger or {"availableNow": True}).start()


# --- queue and counts as snapshots ---

def _snapshot(root: str, batch: int) -> str:
    return f"{root.rstrip('/')}/batch={batch}"


def _batches(spark: SparkSession, root: str) -> list[int]:
    """The batches that have a snapshot under root, oldest first, by their names alone."""
    return sorted(int(n.removeprefix("batch=")) for n in names_in(spark, root) if n.startswith("batch="))


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot under root; only its files are opened."""
    return spark.read.parquet(_snapshot(root, _batches(spark, root)[-1]))


def queue_log(spark: SparkSession, root: str, every: int = 16) -> BatchLog:
    """A queue as the rows that each micro-batch changed; the newest row of a key counts."""
    return BatchLog(spark, root, QUEUE, latest_per_key(QUEUE_KEY), every)


def latest_queue(spark: SparkSession, root: str) -> DataFrame:
    """The queue as the newest micro-batch left it."""
    return queue_log(spark, root).now()


def start_sync(
    readings: DataFrame,
    initial: DataFrame,
    reference: DataFrame,
    past: DataFrame,
    correlation: DataFrame,
    as_of: datetime,
    root: str,
    checkpoint: str,
    every: int = 16,
    **trigger,
) -> StreamingQuery:
    """Score each micro-batch and append the queue rows that its flags change.

    The queue starts from ``initial``, written once.  Batch n merges into the rows of its keys as
    the batches before it left them, so replaying it after a failure writes the same again; every ``every``
    batches the log is folded into a new base.  A micro-batch is an increment: rows absent from it are not cleared;
    the batch sync over the whole flag table does that.  ``past`` and ``correlation`` are read at every
    micro-batch and should be written tables.
    """
    queue = queue_log(readings.sparkSession, root, every)
    queue.start(initial)

    def sync(batch: DataFrame, batch_id: int) -> None:
        queue.compact(batch_id)
        flags = score_readings(batch, reference, as_of, past)
        with pinned(queue_source(flags, correlation)) as source:
            touched = queue.rows(batch_id - 1).join(source.select(*QUEUE_KEY).distinct(), list(QUEUE_KEY), "left_semi")
            merged = merge_queue(queue.fold(touched), source, as_of, clear_missing=False)
            queue.append(merged, batch_id)

    writer = readings.writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger or {"availableNow": True}).start()


def start_live_counts(
    df: DataFrame, by: Sequence[str], root: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Running counts per group, rewritten as a small snapshot at each trigger
    (for a panel: ``processingTime="45 seconds"``)."""
    counts = df.groupBy(*by).agg(F.expr("count(1) AS n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_snapshot(root, batch_id))

    writer = counts.writeStream.outputMode("complete").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(
        **trigger or {"availableNow": True}
    ).start()
