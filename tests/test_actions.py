"""The action fold against a plain walk through each reading's actions."""

import random
from datetime import datetime, timedelta

import pytest

from sigreview import fixed_values as V
from sigreview.operators import actions
from sigreview.schemas import ACTION, QUEUE, RESOLVED_ITEM

START = datetime(2026, 9, 1)


def queue_row(reading, status):
    done = status == V.RESOLVED
    return dict(
        reading_id=reading, compound_id="C", assay_name="A", result_value=1.0, result_unit="uM",
        concern_direction="low", threshold=2.0, threshold_unit="uM", margin=-1.0, compound_prior_n=1,
        compound_prior_mean=1.0, reason="r", status=status, flagged_ts=START, synced_ts=START,
        resolved_by="old" if done else None, resolved_ts=START if done else None,
        resolution_note="old note" if done else None, resolution_reason=V.CONFIRMED if done else None,
        clinical_correlation_state=None, clinical_drug_code=None, clinical_signal_detail=None)


def walk(queue, logged, log):
    """Status, resolver, note and reason per reading, and the first resolver logged."""
    state = {q["reading_id"]: dict(q) for q in queue}
    first = dict(logged)
    for reading, _, seq, action, reason, actor, ts, note in sorted(log, key=lambda a: a[2]):
        q = state.get(reading)
        if q is None:
            continue
        if action == "resolve" and reason in V.RESOLUTION_REASONS and q["status"] == V.OPEN:
            q.update(status=V.RESOLVED, resolved_by=actor, resolved_ts=ts, resolution_note=note, resolution_reason=reason)
            first.setdefault(reading, actor)
        elif action == "reopen" and q["status"] == V.RESOLVED:
            q.update(status=V.OPEN, resolved_by=None, resolved_ts=None, resolution_note=None)
    return state, first


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot_rows", [3, 10**9])
def test_fold_matches_a_walk(spark, seed, hot_rows):
    rng = random.Random(seed)
    queue = [queue_row(f"r{i}", rng.choice([V.OPEN, V.OPEN, V.RESOLVED, V.CLEARED])) for i in range(60)]
    log, seq = [], 0
    for _ in range(500):
        seq += 1
        reading = "r0" if rng.random() < 0.33 else f"r{rng.randint(0, 70)}"
        action = rng.choice(["resolve", "resolve", "reopen", "delete"])
        reason = rng.choice([*V.RESOLUTION_REASONS, "bogus", None]) if action == "resolve" else None
        log.append((reading, "A", seq, action, reason, f"actor{seq}", START + timedelta(hours=seq), f"note{seq}"))
    prior = [(q["reading_id"], "old") for q in queue if q["status"] == V.RESOLVED and rng.random() < 0.5]

    q = spark.createDataFrame([tuple(r[f.name] for f in QUEUE) for r in queue], QUEUE)
    item = {f.name: None for f in RESOLVED_ITEM}
    done = spark.createDataFrame(
        [tuple((item | {"reading_id": r, "assay_name": "A", "resolved_by": by}).values()) for r, by in prior], RESOLVED_ITEM)
    next_queue, next_log = actions.apply_actions(q, done, spark.createDataFrame(log, ACTION), hot_rows)

    state, first = walk(queue, prior, log)
    got = {r.reading_id: r.asDict() for r in next_queue.collect()}
    assert got == state
    assert {r.reading_id: r.resolved_by for r in next_log.collect()} == first


def test_round_trip(spark):
    """Open, resolved, reopened: the status returns, the reason and the log stay."""
    q = spark.createDataFrame([tuple(queue_row("r1", V.OPEN)[f.name] for f in QUEUE)], QUEUE)
    none = spark.createDataFrame([], RESOLVED_ITEM)
    steps = [("r1", "A", 1, "resolve", V.FALSE_POSITIVE, "me", START, "n"), ("r1", "A", 2, "reopen", None, "me", START, None)]
    once, log = actions.apply_actions(q, none, spark.createDataFrame(steps[:1], ACTION))
    assert once.first().status == V.RESOLVED and log.count() == 1
    back, log = actions.apply_actions(once, log, spark.createDataFrame(steps[1:], ACTION))
    row = back.first()
    assert (row.status, row.resolved_by, row.resolution_reason) == (V.OPEN, None, V.FALSE_POSITIVE)
    assert log.first().resolution_reason == V.FALSE_POSITIVE


def test_rejected_actions(spark):
    log = [("r", "A", 1, "resolve", "bogus", "a", START, None), ("r", "A", 2, "resolve", None, "a", START, None),
           ("r", "A", 3, "delete", None, "a", START, None), ("r", "A", 4, "resolve", V.ESCALATED, "a", START, None)]
    accepted, rejected = actions.split_actions(spark.createDataFrame(log, ACTION))
    assert [r.seq for r in accepted.collect()] == [4] and sorted(r.seq for r in rejected.collect()) == [1, 2, 3]
