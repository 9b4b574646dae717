"""Queue sync: what is refreshed, what is kept, what is cleared."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sigreview import fixed_values as V
from sigreview.operators import review_queue as rq
from sigreview.schemas import QUEUE
from test_actions import queue_row

NOW = datetime(2026, 9, 20)


@pytest.fixture(scope="module")
def queue(spark):
    rows = [queue_row(f"{status}-{kind}", status) for status in (V.OPEN, V.RESOLVED, V.CLEARED)
            for kind in ("still", "gone")]
    return spark.createDataFrame([tuple(r[f.name] for f in QUEUE) for r in rows], QUEUE)


@pytest.fixture(scope="module")
def source(spark):
    rows = [queue_row(r, V.OPEN) | {"margin": -9.0, "flagged_ts": NOW}
            for r in ("open-still", "resolved-still", "cleared-still", "brand-new")]
    df = spark.createDataFrame([tuple(r[f.name] for f in QUEUE) for r in rows], QUEUE)
    return df.select("reading_id", *rq.REFRESHED)


def by_id(df):
    return {r.reading_id: r for r in df.collect()}


def test_merge(queue, source):
    got = by_id(rq.merge_queue(queue, source, NOW))
    assert {k: (r.status, r.change) for k, r in got.items()} == {
        "open-still": (V.OPEN, "refreshed"), "resolved-still": (V.RESOLVED, "refreshed"),
        "cleared-still": (V.CLEARED, "refreshed"), "brand-new": (V.OPEN, "inserted"),
        "open-gone": (V.CLEARED, "cleared"), "resolved-gone": (V.RESOLVED, "kept"), "cleared-gone": (V.CLEARED, "kept"),
    }
    kept = got["resolved-still"]
    assert (kept.margin, kept.flagged_ts, kept.resolved_by, kept.resolution_reason) == (-9.0, NOW, "old", V.CONFIRMED)
    assert got["resolved-gone"].synced_ts != NOW and got["open-gone"].synced_ts == NOW
    assert got["brand-new"].resolved_by is None


def test_options(queue, source):
    got = by_id(rq.merge_queue(queue, source, NOW, clear_missing=False, reopen_cleared=True, keep_first_flagged=True))
    assert got["open-gone"].status == V.OPEN and got["cleared-still"].status == V.OPEN
    assert got["open-still"].flagged_ts != NOW and got["brand-new"].flagged_ts == NOW
    assert got["cleared-gone"].status == V.CLEARED


def test_sync_twice_is_sync_once(queue, source):
    once = rq.merge_queue(queue, source, NOW).drop("change")
    twice = rq.merge_queue(once, source, NOW).drop("change")
    assert once.exceptAll(twice).count() == 0 and twice.count() == once.count()


def test_summary_adds_up(queue, source):
    merged = rq.merge_queue(queue, source, NOW)
    s = rq.sync_summary(merged).first()
    assert (s.source_open_flags, s.upserted, s.cleared_stale) == (4, 4, 1)
    counts = {r.status: r.n for r in rq.status_counts(merged).collect()}
    assert counts == {V.OPEN: s.n_open, V.RESOLVED: s.n_resolved, V.CLEARED: s.n_cleared}


def test_empty_source_clears_all_open_rows(queue, source):
    nothing = source.limit(0)
    for cleared in (rq.merge_queue(queue, nothing, NOW).drop("change"), rq.clear_stale(queue, nothing, NOW)):
        assert cleared.where(F.col("status") == V.OPEN).count() == 0
        assert cleared.where(F.col("status") == V.RESOLVED).count() == 2
    assert by_id(rq.clear_stale(queue, source, NOW))["open-gone"].status == V.CLEARED


def test_composite_key_keeps_colliding_readings_apart(queue, source):
    """One reading id flagged in two assays: two rows, if the assay is part of the key."""
    two = source.where("reading_id = 'brand-new'")
    two = two.unionByName(two.withColumn("assay_name", F.lit("B")))
    got = rq.merge_queue(queue.limit(0), two, NOW, key=("reading_id", "assay_name"))
    again = rq.merge_queue(got.drop("change"), two, NOW, key=("reading_id", "assay_name"))
    assert got.count() == again.count() == 2 and {r.change for r in again.collect()} == {"refreshed"}


def test_three_syncs_of_repeated_keys(queue, source):
    """Ids that recur across assays and within one: the queue does not grow, and a sync is idempotent."""
    many = source.unionByName(source.withColumn("assay_name", F.lit("B"))).unionByName(source.withColumn("margin", F.lit(-20.0)))
    now, counts = queue, []
    for _ in range(3):
        before, now = now, rq.merge_queue(now, many, NOW).drop("change").cache()
        counts.append(now.count())
    assert len(set(counts)) == 1 and counts[0] == 6 + 1 + 4
    assert before.exceptAll(now).count() == 0
    assert by_id(now.where("assay_name = 'A'"))["brand-new"].margin == -20.0


def test_insert_if_absent_keeps_one_row_per_key(queue):
    some = queue.where("status = 'resolved'")
    twice = some.unionByName(some.withColumn("reason", F.lit("z")))
    got = rq.insert_if_absent(some.limit(0), twice, rq.QUEUE_KEY)
    assert got.count() == 2 and {r.reason for r in got.collect()} == {"z"}
    assert rq.insert_if_absent(got, twice, rq.QUEUE_KEY).count() == 2


def test_views(queue):
    assert rq.queue_view(queue, None).count() == 6
    assert rq.queue_view(queue, "", 0).count() == 6
    assert rq.queue_view(queue, V.OPEN, 1).count() == 1
    assert rq.find_compounds(queue, "c").count() == 6 and rq.find_compounds(queue, "x").count() == 0
