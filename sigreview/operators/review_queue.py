"""Review queue as immutable snapshots: flags in, human decisions kept."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import stamp
from ..schemas import QUEUE, QUEUE_KEY
from .spread import join_unique, number_rows

REFRESHED = (
    "compound_id", "assay_name", "result_value", "result_unit", "concern_direction", "threshold",
    "threshold_unit", "margin", "compound_prior_n", "compound_prior_mean", "reason", "flagged_ts",
    "clinical_correlation_state", "clinical_drug_code", "clinical_signal_detail",
)

# What a sync did to a row.
INSERTED, REFRESHED_ROW, STALE, KEPT = "inserted", "refreshed", "cleared", "kept"


def with_signal(flags: DataFrame, correlation: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Flags with the signal of their compound."""
    signal = correlation.selectExpr(
        "compound_id",
        "correlation_state AS clinical_correlation_state",
        "drug_code AS clinical_drug_code",
        "signal_detail AS clinical_signal_detail",
    )
    return join_unique(flags, signal, ["compound_id"], spread=["reading_id"], hot_rows=hot_rows)


def queue_source(flags: DataFrame, correlation: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Flagged readings in the shape of the queue's refreshed columns."""
    flagged = flags.where("is_flagged").withColumnRenamed("evaluated_ts", "flagged_ts")
    return with_signal(flagged, correlation, hot_rows).select("reading_id", *REFRESHED)


def one_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by ``order`` (SQL, largest first), ties by all other columns.

    Each task keeps its own first rows before they shuffle, so a key repeated
    any number of times costs one row per task.
    """
    terms = [F.expr(o).desc() for o in order] + [F.col(c).desc() for c in rows.columns if c not in key]
    numbered = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*terms)))
    return numbered.where("_nth = 1").drop("_nth")


# Of several source rows for one key the latest counts, then the widest breach.
SOURCE_ORDER = ("flagged_ts", "abs(margin)")


def merge_queue(
    queue: DataFrame,
    source: DataFrame,
    as_of: datetime,
    *,
    key: Sequence[str] = QUEUE_KEY,
    clear_missing: bool = True,
    reopen_cleared: bool = False,
    keep_first_flagged: bool = False,
) -> DataFrame:
    """The next queue snapshot plus ``change``: inserted, refreshed, cleared or kept.

    Source rows refresh the reasoning columns; status and resolution columns are
    the reviewer's and stay.  Open rows absent from the source are cleared,
    unless ``clear_missing`` is off because the source is only an increment.
    One full outer join on the key does all of it: a snapshot is unique in it, and of
    source rows that share a key one counts (``SOURCE_ORDER``).
    """
    old = queue.selectExpr("*", "TRUE AS present").alias("o")
    new = one_per_key(source, key, SOURCE_ORDER).selectExpr("*", "TRUE AS present").alias("n")
    both = old.join(new, F.expr(" AND ".join(f"o.{k} = n.{k}" for k in key)), "full_outer")
    stale = f"n.present IS NULL AND o.status = '{V.OPEN}' AND {clear_missing}"
    back = f"n.present AND o.status = '{V.CLEARED}' AND {reopen_cleared}"
    out = {f.name: f"o.{f.name}" for f in QUEUE}
    for name in REFRESHED:
        out[name] = f"CASE WHEN n.present THEN n.{name} ELSE o.{name} END"
    if keep_first_flagged:
        out["flagged_ts"] = "coalesce(o.flagged_ts, n.flagged_ts)"
    for name in key:
        out[name] = f"coalesce(o.{name}, n.{name})"
    out["status"] = (
        f"CASE WHEN o.present IS NULL OR ({back}) THEN '{V.OPEN}' "
        f"WHEN {stale} THEN '{V.CLEARED}' ELSE o.status END"
    )
    out["synced_ts"] = f"CASE WHEN n.present OR ({stale}) THEN {stamp(as_of)} ELSE o.synced_ts END"
    out["change"] = (
        f"CASE WHEN o.present IS NULL THEN '{INSERTED}' WHEN n.present THEN '{REFRESHED_ROW}' "
        f"WHEN {stale} THEN '{STALE}' ELSE '{KEPT}' END"
    )
    return both.selectExpr(*[f"{sql} AS {name}" for name, sql in out.items()])


# Queue rows in one bucket.
ROWS_PER_BUCKET = 1_000_000


def save_queue(queue: DataFrame, name: str, path: str, buckets: int | None = None) -> DataFrame:
    """Write a queue as a table bucketed and sorted by its key, and return it as read back.

    :func:`merge_queue` then reads it in place: only the source's rows shuffle, to the queue's buckets.  Without
    ``buckets`` their number follows from the rows, one bucket per million and at least the session's shuffle
    partitions.  What is merged from a bucketed queue lies by bucket already, so the next one takes over
    ``buckets`` from :func:`bucket_count` and is written where it is.
    """
    if buckets is None:
        spread = int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(spread, -(-queue.count() // ROWS_PER_BUCKET))
        queue = queue.repartition(buckets, *QUEUE_KEY)
    writer = queue.write.bucketBy(buckets, *QUEUE_KEY).sortBy(*QUEUE_KEY).option("path", path)
    writer.saveAsTable(name)
    return queue.sparkSession.table(name)


def bucket_count(spark: SparkSession, name: str) -> int:
    """The buckets of a saved queue."""
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    return int(told["Num Buckets"])


def sync_summary(merged: DataFrame) -> DataFrame:
    """One row: source flags, upserted, cleared, and the queue by status afterwards."""
    upserted = f"count_if(change IN ('{INSERTED}', '{REFRESHED_ROW}'))"
    return merged.agg(
        F.expr(f"{upserted} AS source_open_flags"),
        F.expr(f"{upserted} AS upserted"),
        F.expr(f"count_if(change = '{STALE}') AS cleared_stale"),
        *[F.expr(f"count_if(status = '{s}') AS n_{s}") for s in (V.OPEN, V.RESOLVED, V.CLEARED)],
    )


def sync_queue(
    queue: DataFrame, flags: DataFrame, correlation: DataFrame, as_of: datetime, **options
) -> tuple[DataFrame, DataFrame]:
    """(next queue snapshot, one-row summary)."""
    merged = merge_queue(queue, queue_source(flags, correlation), as_of, **options)
    return merged.drop("change"), sync_summary(merged)


def open_rows(queue: DataFrame) -> DataFrame:
    return queue.where(f"status = '{V.OPEN}'")


def stale_rows(queue: DataFrame, source: DataFrame, key: Sequence[str] = QUEUE_KEY) -> DataFrame:
    """Open queue rows whose reading is no longer flagged."""
    return open_rows(queue).join(source.select(*key), list(key), "left_anti")


def clear_stale(
    queue: DataFrame, source: DataFrame, as_of: datetime, key: Sequence[str] = QUEUE_KEY
) -> DataFrame:
    """The queue with stale open rows cleared; an empty source clears every open row."""
    current = source.select(*key).distinct().selectExpr("*", "TRUE AS is_current")
    stale = f"status = '{V.OPEN}' AND is_current IS NULL"
    changed = {
        "status": f"CASE WHEN {stale} THEN '{V.CLEARED}' ELSE status END",
        "synced_ts": f"CASE WHEN {stale} THEN {stamp(as_of)} ELSE synced_ts END",
    }
    return queue.join(current, list(key), "left").selectExpr(
        *[f"{changed[c]} AS {c}" if c in changed else c for c in queue.columns])


def insert_if_absent(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Target plus one row for each key that it does not have yet."""
    return target.unionByName(one_per_key(rows, key).join(target.select(*key), list(key), "left_anti"))


def with_status(queue: DataFrame, status: str | None) -> DataFrame:
    return queue.where(F.col("status") == status) if status else queue


QUEUE_ORDER = ("margin ASC NULLS LAST", "compound_id", "reading_id", "assay_name")


def queue_view(queue: DataFrame, status: str | None = V.OPEN, limit: int | None = None) -> DataFrame:
    """Queue rows, worst signed margin first; no status means all, no limit means all."""
    rows = with_status(queue, status).orderBy(
        F.col("margin").asc_nulls_last(), "compound_id", "reading_id", "assay_name")
    return rows.limit(limit) if limit else rows


def queue_positions(queue: DataFrame, status: str | None = V.OPEN) -> DataFrame:
    """The order of :func:`queue_view` as an explicit ``position`` column."""
    return number_rows(with_status(queue, status), QUEUE_ORDER)


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.expr("count(1) AS n"))


def find_compounds(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring search on the compound id; empty text finds all."""
    return df.where(F.contains(F.lower("compound_id"), F.lit(text.lower())))
