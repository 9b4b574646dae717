"""Reviewer actions folded into the queue and the log of first resolutions.

The rules, per reading and in the order of ``seq``: a resolve counts only while
the row is open, a reopen only while it is resolved, everything else is void.
A cleared row takes no action.  The resolved log keeps the first resolution.

A reading may have any number of actions.  Instead of walking its list in one
task, the fold is written as three grouped aggregates that combine map-side:

* the last action of an open or resolved row fixes its final status;
* a resolve counts if it is the first one after some reopen (or at the start of
  an open row), so the one in force is the first after the last reopen that
  precedes the last resolve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..schemas import QUEUE, QUEUE_KEY, RESOLVED_ITEM
from .review_queue import insert_if_absent
from .spread import HOT_ROWS, join_unique

RESOLVE, REOPEN = "resolve", "reopen"

_FACTS = "struct(resolution_reason, actor, action_ts, note)"


def split_actions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a resolve needs one of the known reasons, a reopen none."""
    reasons = ", ".join(f"'{r}'" for r in V.RESOLUTION_REASONS)
    fine = (
        f"coalesce(action = '{REOPEN}' OR (action = '{RESOLVE}' AND resolution_reason IN ({reasons})), FALSE)"
    )
    return actions.where(fine), actions.where(f"NOT {fine}")


def apply_actions(
    queue: DataFrame, resolved: DataFrame, actions: DataFrame, hot_rows: int = HOT_ROWS,
    key: Sequence[str] = QUEUE_KEY,
) -> tuple[DataFrame, DataFrame]:
    """(next queue, next resolved log) after all accepted actions of the log."""
    log, _ = split_actions(actions)
    key = list(key)
    resolve, reopen = f"action = '{RESOLVE}'", f"action = '{REOPEN}'"

    # Only rows that take actions at all; a key is in the queue once.
    live = queue.where(f"status IN ('{V.OPEN}', '{V.RESOLVED}')").selectExpr(
        *key, f"status = '{V.OPEN}' AS starts_open")
    spans = log.groupBy(*key).agg(
        F.expr("count(1) AS rows"),
        F.expr(f"max(CASE WHEN {resolve} THEN seq END) AS last_resolve"),
        F.expr(f"max(CASE WHEN {reopen} THEN seq END) AS last_reopen"),
        F.expr(f"min(CASE WHEN {reopen} THEN seq END) AS first_reopen"),
    ).join(live, key, "inner")
    weights = spans.select(*key, "rows")

    def log_with(facts: DataFrame) -> DataFrame:
        return join_unique(log, facts, key, "inner", spread=["seq"], weights=weights, hot_rows=hot_rows)

    first_legal = f"{resolve} AND (starts_open OR seq > first_reopen)"
    turns = log_with(spans.drop("rows")).groupBy(*key).agg(
        F.expr(f"max(CASE WHEN {reopen} AND seq < last_resolve THEN seq END) AS turn"),
        F.expr(f"min_by({_FACTS}, CASE WHEN {first_legal} THEN seq END) AS first_one"),
    )
    spans = spans.join(turns, key, "inner")
    in_force = f"{resolve} AND CASE WHEN turn IS NULL THEN starts_open ELSE seq > turn END"
    last = log_with(spans.select(*key, "turn", "starts_open")).groupBy(*key).agg(
        F.expr(f"min_by({_FACTS}, CASE WHEN {in_force} THEN seq END) AS in_force"))
    outcome = spans.join(last, key, "inner").selectExpr(
        *key, "first_one", "in_force",
        "last_resolve IS NOT NULL AND (last_reopen IS NULL OR last_resolve > last_reopen) AS ends_resolved",
    )
    acted = queue.join(outcome, key, "left")
    return _next_queue(acted), insert_if_absent(resolved, _new_log_rows(acted), key)


def _next_queue(acted: DataFrame) -> DataFrame:
    """Queue columns after the actions; rows without any have NULL ends_resolved."""
    reopened = f"NOT ends_resolved AND (status = '{V.RESOLVED}' OR in_force IS NOT NULL)"

    def carried(column: str, fact: str) -> str:
        return (
            f"CASE WHEN {reopened} THEN NULL WHEN ends_resolved AND in_force IS NOT NULL "
            f"THEN in_force.{fact} ELSE {column} END"
        )

    changed = {
        "status": f"CASE WHEN ends_resolved THEN '{V.RESOLVED}' WHEN {reopened} THEN '{V.OPEN}' ELSE status END",
        "resolved_by": carried("resolved_by", "actor"),
        "resolved_ts": carried("resolved_ts", "action_ts"),
        "resolution_note": carried("resolution_note", "note"),
        # A reopen leaves the reason of the last resolution in place.
        "resolution_reason": "CASE WHEN in_force IS NOT NULL THEN in_force.resolution_reason ELSE resolution_reason END",
    }
    return acted.selectExpr(*[f"{changed.get(f.name, f.name)} AS {f.name}" for f in QUEUE])


def _new_log_rows(acted: DataFrame) -> DataFrame:
    facts = {
        "resolution_reason": "first_one.resolution_reason", "resolved_by": "first_one.actor",
        "resolved_ts": "first_one.action_ts", "resolution_note": "first_one.note",
    }
    return acted.where("first_one IS NOT NULL").selectExpr(
        *[f"{facts.get(f.name, f.name)} AS {f.name}" for f in RESOLVED_ITEM])
