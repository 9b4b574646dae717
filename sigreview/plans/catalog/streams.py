"""Incremental forms, run to the end of what is there, then read back."""

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ...operators import scoring
from ...schemas import READING
from ...session import is_folder, pin, scratch_path
from ...sources import envelope, lines
from ...streaming import arrivals, incremental
from .. import bindings as B
from . import sources
from .base import query

READING_COLUMNS = ", ".join(READING.fieldNames())


def _event_stream(spark, d):
    """The events table as a stream of readings: all files of a folder, or the one file."""
    schema, path = B.events(spark, d).schema, f"{d}/events.parquet"
    source = spark.readStream.schema(schema)
    if is_folder(spark, path):
        rows = source.parquet(path)
    else:
        rows = source.option("pathGlobFilter", "events.parquet").parquet(d)
    return B.readings_of(rows)


def _run(query_, name):
    query_.awaitTermination()
    if query_.exception():
        raise query_.exception()
    return name


def _appended(spark, df, name):
    out = scratch_path(spark, name)
    _run(incremental.start_append(df, out, scratch_path(spark, f"{name}-state")), name)
    return spark.read.schema(df.schema).parquet(out)


@query("t1_page_stream", f"SELECT {READING_COLUMNS} FROM bronze")
def page_stream(spark, d):
    pages = scratch_path(spark, "landed")
    B.page_bodies(spark, d).select("body").write.text(pages)
    return _appended(spark, incremental.stream_readings(spark, pages, 2), "bronze")


@query("t1_paged_source_stream", f"SELECT {READING_COLUMNS} FROM bronze")
def paged_source_stream(spark, d):
    """Pages that arrive in two lots, the last one partly filled; each lot is taken up as it comes."""
    bodies, path = pin(B.page_bodies(spark, d)), scratch_path(spark, "landed-pages")
    out, state = scratch_path(spark, "bronze-lots"), scratch_path(spark, "bronze-lots-state")
    middle = bodies.agg(F.expr("max(page_offset) DIV 2")).scalar()
    for lot in (F.col("page_offset") < middle, F.col("page_offset") >= middle):
        bodies.where(lot).select("body").write.mode("append").text(path)
        _run(incremental.start_append(incremental.stream_readings(spark, path), out, state), "bronze")
    return spark.read.schema(READING).parquet(out)


@query("t1_landing_stream", sources._REJECTS)
def landing_stream(spark, d):
    """Pages and lines that are none arrive in two lots; one query keeps both kinds, here the rejects."""
    bodies, path = pin(sources._mixed_bodies(spark, d)), scratch_path(spark, "mixed-lots")
    out, state = scratch_path(spark, "mixed-out"), scratch_path(spark, "mixed-state")
    middle = bodies.agg(F.expr("max(page_offset) DIV 2")).scalar()
    for lot in (F.col("page_offset") < middle, F.col("page_offset") >= middle):
        bodies.where(lot).select("body").write.mode("append").text(path)
        _run(lines.start_landing(lines.stream_lines(spark, path), envelope.PAGE_LINE, out, state), "landing")
    return lines.landed(spark, envelope.PAGE_LINE, out)[1].select("body", "reject_reason")


# Arrivals of the two queries below: first the readings with an even number, then all of them.
_LATE = """acquired_ts <= (SELECT max(acquired_ts) FROM readings WHERE event_id % 2 = 0) - INTERVAL 20 DAY"""


def _two_arrivals(spark, d, start):
    path = scratch_path(spark, "arrivals")
    rows = B.readings(spark, d).select("sample_id", "assay_name", "acquired_ts")
    for lot in (rows.where("CAST(sample_id AS BIGINT) % 2 = 0"), rows):
        lot.write.mode("append").parquet(path)
        _run(start(spark.readStream.schema(rows.schema).parquet(path)), "arrivals")
    return rows.schema


@query("t2_drop_repeats", f"""
    SELECT sample_id, assay_name, acquired_ts FROM readings WHERE event_id % 2 = 0 OR NOT ({_LATE})""")
def drop_repeats(spark, d):
    """Half of the readings arrive twice and are kept once; what comes too late is left out."""
    out, state = scratch_path(spark, "once"), scratch_path(spark, "once-state")
    schema = _two_arrivals(spark, d, lambda rows: incremental.start_append(
        incremental.drop_repeats(rows, "20 days"), out, state))
    return spark.read.schema(schema).parquet(out)


def _arrived(spark, d):
    """Both lots through the stateful query, read back."""
    root, state = scratch_path(spark, "arrived"), scratch_path(spark, "arrived-state")
    schema = _two_arrivals(spark, d, lambda rows: arrivals.start_arrivals(rows, root, state, "20 days"))
    return spark.read.schema(StructType([*schema.fields, StructField("arrival", StringType())])).parquet(root)


@query("t2_arrivals", f"""
    SELECT sample_id, assay_name, acquired_ts, 'kept' AS arrival FROM readings WHERE event_id % 2 = 0 UNION ALL
    SELECT sample_id, assay_name, acquired_ts, CASE WHEN {_LATE} THEN 'late' WHEN event_id % 2 = 0 THEN 'repeated' ELSE 'kept' END
    FROM readings""")
def told_apart(spark, d):
    """Every row of both lots with what it was on arrival."""
    return _arrived(spark, d)


@query("t2_late_rows", f"SELECT sample_id, assay_name, acquired_ts FROM readings WHERE {_LATE}")
def late_rows(spark, d):
    """What came too late in the second lot, kept aside."""
    return _arrived(spark, d).where(f"arrival = '{arrivals.LATE}'").drop("arrival")


@query("t2_every_file", "SELECT sample_id, assay_name, acquired_ts FROM readings")
def every_file(spark, d):
    """Every reading arrives twice, and all of the table's files are read."""
    twice = _event_stream(spark, d).select("sample_id", "assay_name", "acquired_ts").withColumn(
        "copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _appended(spark, incremental.drop_repeats(twice, "30 days"), "once")


@query("t3_score_stream", "SELECT * FROM lagging_flags")
def score_stream(spark, d):
    """Scored against a history that ends before most of the readings."""
    past = pin(scoring.history(B.readings(spark, d).where("acquired_ts < TIMESTAMP_NTZ '2024-01-03 00:00:00'")))
    scored = incremental.score_stream(_event_stream(spark, d), B.reference(spark), past, B.AS_OF)
    return _appended(spark, scored, "flags")


def _moved(spark, d):
    """All readings in two lots, each scored against the history of the one before."""
    path, root, state = (scratch_path(spark, n) for n in ("scored-in", "scored", "scored-state"))
    rows = B.readings(spark, d)
    for lot in ("CAST(sample_id AS BIGINT) % 2 = 0", "CAST(sample_id AS BIGINT) % 2 = 1"):
        rows.where(lot).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        _run(incremental.start_scores(stream, B.reference(spark), B.AS_OF, root, state), "scores")
    return root


@query("t3_moving_history", "SELECT * FROM moving_flags")
def moving_history(spark, d):
    """The second lot sees the history that the first one left, the first lot none."""
    return spark.read.parquet(incremental.scores_root(_moved(spark, d))).drop("batch")


@query("t3_history_after", "SELECT * FROM hist")
def history_after(spark, d):
    """After all lots the moving history is that of the whole table."""
    return incremental.latest_history(spark, _moved(spark, d))


@query("t4_sync_stream", """
    SELECT * EXCLUDE (change) REPLACE (CASE WHEN change = 'cleared' THEN 'open' ELSE status END AS status,
      CASE WHEN change = 'cleared' THEN TIMESTAMP '2024-01-30 00:00:00' ELSE synced_ts END AS synced_ts) FROM merged""")
def sync_stream(spark, d):
    root, past = scratch_path(spark, "queue"), B.written_history(spark, d)
    flags = B.written_flags(spark, d, past)
    running = incremental.start_sync(
        _event_stream(spark, d), B.prior_queue(spark, d, past), B.reference(spark), past,
        pin(B.correlation(spark, d, flags)), B.AS_OF, root, scratch_path(spark, "queue-state"))
    _run(running, "queue")
    return incremental.latest_queue(spark, root)


@query("t5_live_counts", "SELECT assay_name, count(*) AS n FROM readings GROUP BY assay_name")
def live_counts(spark, d):
    root = scratch_path(spark, "live")
    running = incremental.start_live_counts(
        _event_stream(spark, d), ["assay_name"], root, scratch_path(spark, "live-state"))
    _run(running, "live")
    return incremental.latest_snapshot(spark, root)
