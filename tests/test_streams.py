"""Incremental forms over two arrivals, and the whole batch end to end."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

import fixtures as fx
from sigreview import fixed_values as V
from sigreview.operators import correlate, deidentify, scoring
from sigreview.plans import stages
from sigreview.plans.catalog import QUERIES
from sigreview.schemas import ACTION, QUEUE, QUEUE_KEY, READING
from sigreview.session import names_in, scratch_path
from sigreview.sources import envelope
from sigreview.streaming import arrivals, batch_log, incremental
from test_actions import queue_row


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_pages_arrive_in_two_lots(spark):
    sent = fx.readings(spark)
    bodies = envelope.write_envelopes(sent, page_size=4).cache()
    files, out, state = scratch_path(spark, "t-files"), scratch_path(spark, "t-a"), scratch_path(spark, "t-as")
    seen = []
    for lot in ("page_offset < 12", "page_offset >= 12"):
        bodies.where(lot).select("body").write.mode("append").text(files)
        finish(incremental.start_append(incremental.stream_readings(spark, files), out, state))
        seen.append(spark.read.schema(READING).parquet(out).count())
    assert seen == [12, sent.count()]
    assert same(spark.read.schema(READING).parquet(out), sent)


@pytest.fixture(scope="module")
def folder(spark):
    """The tables of sf0.001 with events as a folder of part files."""
    root, given = scratch_path(spark, "t-tables"), "/root/testdata/sf0.001"
    spark.read.parquet(f"{given}/events.parquet").repartition(5).write.parquet(f"{root}/events.parquet")
    spark.read.parquet(f"{given}/orders.parquet").write.parquet(f"{root}/orders.parquet")
    return root


@pytest.mark.parametrize("key", ["t2_every_file", "t2_drop_repeats", "t2_arrivals", "t2_late_rows", "t3_score_stream", "t3_moving_history", "t4_sync_stream", "t5_live_counts"])
def test_streams_over_folders_give_what_files_give(spark, folder, key):
    a, b = QUERIES[key](spark, folder), QUERIES[key](spark, "/root/testdata/sf0.001")
    assert b.count() > 0 and same(a, b)


def _queue_rows(spark, ids, **values):
    rows = [queue_row(i, V.OPEN) | values for i in ids]
    return spark.createDataFrame([tuple(r[f.name] for f in QUEUE) for r in rows], QUEUE)


def _parts(spark, root, kind):
    return sorted(names_in(spark, f"{root}/kind={kind}"))


def test_batches_append_fold_and_replay(spark):
    root = scratch_path(spark, "t-log")
    log = incremental.queue_log(spark, root, every=3)
    assert log.now().count() == 0 and log.now().columns == QUEUE.fieldNames()
    log.start(_queue_rows(spark, [f"r{i}" for i in range(40)]))
    log.start(_queue_rows(spark, ["never"]))
    for n in range(3):
        log.append(_queue_rows(spark, [f"r{n}", f"new{n}"], margin=-11.0 - n), n)
    # A batch wrote its own rows and nothing else, and a replay replaces them.
    assert _parts(spark, root, "changes") == ["batch=0", "batch=1", "batch=2"] and _parts(spark, root, "base") == ["batch=-1"]
    assert spark.read.parquet(f"{root}/kind=changes/batch=1").count() == 2
    before = log.now().cache()
    assert before.count() == 43 and {r.margin for r in before.where("reading_id IN ('r2', 'new2')").collect()} == {-13.0}
    log.append(_queue_rows(spark, ["r2", "new2"], margin=-13.0), 2)
    assert same(before, log.now())
    assert log.before(1).where("margin = -11.0").count() == 2 and log.before(1).where("margin < -11.0").count() == 0
    # Three batches since the base: they are folded before the next one runs, which sees the same rows.
    assert not log.compact(2) and log.compact(3) and not log.compact(3)
    assert _parts(spark, root, "base") == ["batch=-1", "batch=2"] and same(before, log.before(3)) and same(before, log.now())
    for n in range(3, 6):
        log.append(_queue_rows(spark, [f"r{n}"], margin=-90.0), n)
    assert log.compact(6)
    assert _parts(spark, root, "base") == ["batch=2", "batch=5"] and _parts(spark, root, "changes") == ["batch=3", "batch=4", "batch=5"]
    assert log.now().count() == 43 and log.now().where("margin = -90.0").count() == 3
    assert log.before(5).where("margin = -90.0").count() == 2


def test_a_base_has_as_many_files_as_its_rows_need(spark):
    root = scratch_path(spark, "t-files")
    log = batch_log.BatchLog(spark, root, QUEUE, batch_log.latest_per_key(QUEUE_KEY), every=1, rows_per_file=10)
    log.append(_queue_rows(spark, [f"r{i}" for i in range(95)]), 0)
    assert log.compact(1)
    files = [n for n in names_in(spark, f"{root}/kind=base/batch=0") if n.endswith(".parquet")]
    assert len(files) == 10 and log.now().count() == 95


def _uncommit(checkpoint, batch):
    """As if the run had failed after the batch's writes: the next start runs it again."""
    for name in (f"{batch}", f".{batch}.crc"):
        Path(checkpoint, "commits", name).unlink(missing_ok=True)


@pytest.fixture()
def lots(spark):
    """Readings with recurring pairs in four lots, by replicate, and one with values a decimal can't hold."""
    base = fx.readings(spark)
    odd = base.limit(2).withColumn("result_value", F.expr("CAST('NaN' AS DOUBLE)")).withColumn("sample_id", F.concat(F.lit("nan-"), "sample_id"))
    more = base.withColumn("result_value", F.expr("result_value * 1.5")).withColumn("sample_id", F.concat(F.lit("again-"), "sample_id"))
    less = base.withColumn("result_value", F.lit(None).cast("double")).withColumn("sample_id", F.concat(F.lit("none-"), "sample_id"))
    return [base, more.where("replicate % 2 = 0"), less, more.where("replicate % 2 = 1").unionByName(odd)]


def test_history_moves_with_the_stream(spark, lots):
    path, root, state = (scratch_path(spark, n) for n in ("t-in", "t-scores", "t-state"))
    stream = spark.readStream.schema(READING).parquet
    for n, lot in enumerate(lots):
        lot.coalesce(1).write.mode("append").parquet(path)
        for again in range(2):
            finish(incremental.start_scores(stream(path), fx.reference(spark), fx.AS_OF, root, state, every=2))
            seen = lots[0].limit(0)
            for earlier in lots[:n]:
                seen = seen.unionByName(earlier)
            got = spark.read.parquet(f"{incremental.scores_root(root)}/batch={n}")
            assert same(got, scoring.score_readings(lot, fx.reference(spark), fx.AS_OF, scoring.history(seen)))
            assert same(incremental.latest_history(spark, root), scoring.history(seen.unionByName(lot)))
            _uncommit(state, n)  # the second time the batch is a replay
    assert _parts(spark, f"{root}/history", "base") == ["batch=1"]


def test_initial_history(spark, lots):
    path, root, state = (scratch_path(spark, n) for n in ("t-in", "t-scores", "t-state"))
    lots[1].coalesce(1).write.parquet(path)
    finish(incremental.start_scores(spark.readStream.schema(READING).parquet(path), fx.reference(spark), fx.AS_OF, root, state,
                                    initial=scoring.history_parts(lots[0])))
    got = spark.read.parquet(f"{incremental.scores_root(root)}/batch=0")
    assert same(got, scoring.score_readings(lots[1], fx.reference(spark), fx.AS_OF, scoring.history(lots[0])))
    assert same(incremental.latest_history(spark, root), scoring.history(lots[0].unionByName(lots[1])))


ARRIVAL = StructType([*READING.fields[:6], *READING.fields[8:9]])


def _arrive(spark, names, rows):
    """One more lot through the stateful query: (sample, assay, plate, time) to what is stored now."""
    path, out, state = names
    given = [(s, "c", p, None, 1, a, datetime(2026, 9, 1) + timedelta(hours=h) if h is not None else None) for s, a, p, h in rows]
    spark.createDataFrame(given, ARRIVAL).repartition(2).write.mode("append").parquet(path)
    query = arrivals.start_arrivals(spark.readStream.schema(ARRIVAL).parquet(path), out, state, "10 hours")
    finish(query)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    found = spark.read.schema(StructType([*ARRIVAL.fields, StructField("arrival", StringType())])).parquet(out)
    return sorted((r.sample_id, r.assay_name, r.plate, r.arrival) for r in found.collect()), held[-1]


def test_arrivals_are_told_apart_across_restarts(spark):
    names = [scratch_path(spark, n) for n in ("t-in", "t-out", "t-state")]
    first, _ = _arrive(spark, names, [("a", "x", "2", 1), ("a", "x", "1", 0), ("a", "x", "3", 2), ("a", "y", "1", 0), ("b", "x", "1", 20),
                                      ("n", "x", "1", None), ("n", "x", "2", None)])
    # Of a key's rows in one batch the earliest is kept; a row without a time is neither kept nor remembered.
    assert first == [("a", "x", "1", "kept"), ("a", "x", "2", "repeated"), ("a", "x", "3", "repeated"), ("a", "y", "1", "kept"),
                     ("b", "x", "1", "kept"), ("n", "x", "1", "untimed"), ("n", "x", "2", "untimed")]
    # The watermark is at 10 hours now: what is at or before it is late, also where the key is known or new.
    second, _ = _arrive(spark, names, [("a", "x", "4", 10), ("c", "x", "1", 3), ("b", "x", "2", 21), ("n", "x", "3", 11), ("d", "x", "1", 40)])
    assert [r for r in second if r not in first] == [
        ("a", "x", "4", "late"), ("b", "x", "2", "repeated"), ("c", "x", "1", "late"), ("d", "x", "1", "kept"), ("n", "x", "3", "kept")]
    # At 30 hours the first keys are forgotten: b counts anew, d is still known.
    third, held = _arrive(spark, names, [("b", "x", "3", 41), ("d", "x", "2", 42), ("a", "x", "5", 29), ("e", "x", "1", 90)])
    assert [r for r in third if r not in second] == [
        ("a", "x", "5", "late"), ("b", "x", "3", "kept"), ("d", "x", "2", "repeated"), ("e", "x", "1", "kept")]
    # At 80 hours all keys but e are forgotten.
    _, later = _arrive(spark, names, [("f", "x", "1", 91)])
    assert (held, later) == (1, 2)


def test_rows_that_tie_are_kept_by_their_hash(spark):
    rows = [("a", "x", p, 5) for p in "12345"]
    kept = set()
    for given in (rows, rows[::-1]):
        found, _ = _arrive(spark, [scratch_path(spark, n) for n in ("t-in", "t-out", "t-state")], given)
        assert sorted(r[3] for r in found) == ["kept"] + ["repeated"] * 4
        kept |= {r[2] for r in found if r[3] == "kept"}
    assert len(kept) == 1
    assert spark.conf.get(arrivals.PROVIDER, None) != arrivals.ROCKS


def test_repeats_within_the_delay_are_dropped(spark):
    path, out, state = (scratch_path(spark, n) for n in ("t-in", "t-out", "t-state"))
    rows = fx.readings(spark)
    for _ in range(2):
        rows.write.mode("append").parquet(path)
        stream = spark.readStream.schema(READING).parquet(path)
        finish(incremental.start_append(incremental.drop_repeats(stream, "1 day"), out, state))
    assert same(spark.read.schema(READING).parquet(out), rows)
    late = rows.limit(1).selectExpr("'late' AS sample_id", *[c for c in rows.columns if c not in ("sample_id", "acquired_ts")],
                                    "acquired_ts - INTERVAL 9 DAYS AS acquired_ts").select(*rows.columns)
    late.write.mode("append").parquet(path)
    finish(incremental.start_append(incremental.drop_repeats(stream, "1 day"), out, state))
    assert spark.read.schema(READING).parquet(out).where("sample_id = 'late'").count() == 0


def test_sync_by_micro_batch_ends_like_one_sync(spark):
    path, root, state = (scratch_path(spark, n) for n in ("t-in", "t-queue", "t-state"))
    readings = fx.readings(spark).cache()
    past = scoring.history(readings)
    obs = deidentify.deidentify(fx.observations(spark), salt=":s")
    flags = scoring.score_readings(readings, fx.reference(spark), fx.AS_OF)
    signal = correlate.correlate(flags, fx.crosswalk(spark), obs, fx.AS_OF).cache()
    empty = spark.createDataFrame([], QUEUE)
    for lot in ("replicate < 10", "replicate >= 10"):
        readings.where(lot).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).parquet(path)
        for _ in range(2):
            finish(incremental.start_sync(stream, empty, fx.reference(spark), past, signal, fx.AS_OF, root, state, every=1))
            _uncommit(state, max(int(n) for n in names_in(spark, f"{state}/commits") if n.isdigit()))  # then a replay
    queue = incremental.latest_queue(spark, root)
    assert same(queue.select("reading_id", "reason", "clinical_correlation_state"),
                flags.where("is_flagged").join(signal, "compound_id", "left").selectExpr(
                    "reading_id", "reason", "correlation_state AS clinical_correlation_state"))
    counts = scratch_path(spark, "t-live")
    finish(incremental.start_live_counts(stream, ["assay_name"], counts, scratch_path(spark, "t-ls")))
    live = {r.assay_name: r.n for r in incremental.latest_snapshot(spark, counts).collect()}
    assert live["hERG_IC50"] == 11 and sum(live.values()) == readings.count()


def _body(spark, df):
    names = [{"name": n, "path": f"/{n}"} for n in df.columns]
    cells = ", ".join(f"CAST({n} AS STRING)" for n in df.columns)
    header = ", ".join(f"named_struct('name', '{c['name']}', 'path', '{c['path']}')" for c in names)
    return df.selectExpr(f"to_json(named_struct('columns', array({header}), 'rows', array(array({cells})))) AS body")


def test_whole_batch_twice(spark):
    """From pages to tasks; the second run keeps what reviewers decided."""
    from sigreview.sources import resultset

    pages = envelope.parse_pages(envelope.write_envelopes(fx.readings(spark), page_size=7))
    sets = resultset.parse_result_sets(_body(spark, fx.observations(spark)))

    def run(as_of, **state):
        batch = stages.Batch(spark, scratch_path(spark, "t-batch"), as_of, salt=":s")
        stages.run_readings(batch, pages, fx.reference(spark))
        stages.run_clinical(batch, sets, fx.crosswalk(spark))
        stages.run_review(batch, **state)
        return batch.tables

    first = run(fx.AS_OF)
    assert first["assay_results_raw"].count() == first["assay_results"].count() + first["assay_results_quarantine"].count()
    assert first["sync_summary"].first().n_open == 14
    assert {r.correlation_state for r in first["clinical_correlation_summary"].collect()} == {V.CORRELATED, V.CHECKED, V.NO_MAPPING}
    assert first["recommendation_prompts"].count() == 8

    herg = first["review_queue"].where("assay_name = 'hERG_IC50'").select("reading_id").collect()
    log = [(r.reading_id, "hERG_IC50", i, "resolve", V.FALSE_POSITIVE if i < 2 else V.CONFIRMED, "me", fx.AS_OF + timedelta(hours=i + 1), None)
           for i, r in enumerate(herg)]
    second = run(datetime(2026, 9, 15), queue=first["review_queue"], resolved=first["resolved_items"],
                 log=spark.createDataFrame(log, ACTION), tasks=first["threshold_review_tasks"])
    assert {r.status: r.n for r in second["review_queue"].groupBy("status").count().withColumnRenamed("count", "n").collect()} == {
        V.OPEN: 7, V.RESOLVED: 7}
    assert second["triage_kpis"].first().resolved_count == 7
    assert [r.assay_name for r in second["threshold_review_tasks"].collect()] == ["hERG_IC50"]
    third = run(datetime(2026, 9, 16), queue=second["review_queue"], resolved=second["resolved_items"],
                tasks=second["threshold_review_tasks"])
    assert third["review_queue"].where("status = 'resolved'").count() == 7
