"""Arrivals by bucket: many keys share a bucket's state and timer."""

import random
from datetime import datetime, timedelta

from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from sigreview.session import scratch_path
from sigreview.streaming import arrivals

ROW = StructType([StructField("sample_id", StringType()), StructField("assay_name", StringType()), StructField("row", StringType()),
                  StructField("acquired_ts", TimestampType())])
START, DELAY = datetime(2026, 9, 1), timedelta(hours=5)


def _lots(seed):
    """Lots of rows at different seconds: many keys, some null, some rows untimed; time moves on from lot to lot."""
    deal = random.Random(seed)
    for n in range(4):
        names = [None, *(f"s{deal.randrange(60)}" for _ in range(200))]
        at = [deal.randrange(0, 14 * 3600) + n * 6 * 3600 for _ in names]
        yield [(name, deal.choice(["x", "y", None]), f"{n}-{i}", START + timedelta(seconds=s, milliseconds=i) if deal.random() < 0.95 else None)
               for i, (name, s) in enumerate(zip(names, at))]


def _expected(lots):
    """What each row is, key by key as the contract of label_arrivals says."""
    mark, until, out = None, {}, []
    for lot in lots:
        first = {}
        for name, assay, row, ts in sorted((r for r in lot if r[3]), key=lambda r: r[3]):
            if mark is not None and ts <= mark:
                out.append((row, "late"))
            elif (name, assay) in until or (name, assay) in first:
                out.append((row, "repeated"))
            else:
                first[name, assay] = ts + DELAY
                out.append((row, "kept"))
        out += [(r[2], "untimed") for r in lot if not r[3]]
        newest = max(r[3] for r in lot if r[3]) - DELAY
        mark = newest if mark is None else max(mark, newest)
        until = {k: u for k, u in (until | first).items() if u > mark}
    return sorted(out), until


def test_many_keys_share_a_bucket(spark):
    path, out, state = (scratch_path(spark, n) for n in ("t-in", "t-out", "t-state"))
    lots = list(_lots(5))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")  # a bucket's rows come in several pieces
    try:
        for lot in lots:
            spark.createDataFrame(lot, ROW).repartition(3).write.mode("append").parquet(path)
            query = arrivals.start_arrivals(spark.readStream.schema(ROW).parquet(path), out, state, "5 hours", buckets=8)
            query.awaitTermination()
            assert query.exception() is None
            held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
            # State goes by bucket, not by key.
            assert 0 < max(held) <= 8
    finally:
        spark.conf.set(size, before)
    found = spark.read.schema(StructType([*ROW.fields, StructField("arrival", StringType())])).parquet(out)
    expected, known = _expected(lots)
    assert sorted((r.row, r.arrival) for r in found.collect()) == expected
    assert len(known) > 8 and {kind for _, kind in expected} == {"kept", "repeated", "late", "untimed"}


def test_keys_of_other_types_stay_apart(spark):
    """Instants a microsecond apart, bytes that are no text, and null beside the text null are different keys."""
    rows = spark.sql("""SELECT * FROM VALUES
        (TIMESTAMP '2026-09-01 00:00:00.000001', X'FF', 'null', 0.0D), (TIMESTAMP '2026-09-01 00:00:00.000002', X'FF', 'null', 0.0D),
        (TIMESTAMP '2026-09-01 00:00:00.000001', X'FE', 'null', 0.0D), (TIMESTAMP '2026-09-01 00:00:00.000001', X'FF', NULL, 0.0D),
        (TIMESTAMP '2026-09-01 00:00:00.000001', X'FF', NULL, -0.0D) AS t(instant, code, word, number)""").selectExpr(
            "*", "TIMESTAMP '2026-09-02 00:00:00' AS acquired_ts")
    path, out, state = (scratch_path(spark, n) for n in ("t-in", "t-out", "t-state"))
    rows.coalesce(1).write.parquet(path)
    query = arrivals.start_arrivals(spark.readStream.schema(rows.schema).parquet(path), out, state, key=("instant", "code", "word", "number"),
                                    buckets=1)
    query.awaitTermination()
    assert query.exception() is None
    assert sorted(r.arrival for r in spark.read.parquet(out).collect()) == ["kept"] * 4 + ["repeated"]
