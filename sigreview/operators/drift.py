"""Drift of the false-positive rate per assay, and the review tasks it opens."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text
from ..schemas import REVIEW_TASK


def drift_rates(
    resolved: DataFrame,
    tolerance: float = V.DRIFT_TOLERANCE,
    min_resolved: int = V.DRIFT_MIN_RESOLVED,
    by: Sequence[str] = ("assay_name",),
) -> DataFrame:
    """Resolved count, false positives, rate and label per group.

    Drift needs enough resolutions and a rate strictly above the tolerance.
    """
    counted = resolved.groupBy(*by).agg(
        F.expr("count(1) AS n_resolved"),
        F.expr(f"count_if(resolution_reason = '{V.FALSE_POSITIVE}') AS n_false_positive"),
    )
    rated = counted.selectExpr(
        "*", "coalesce(try_divide(n_false_positive, n_resolved), 0.0D) AS observed_fpr")
    return rated.selectExpr(
        "*",
        f"CASE WHEN n_resolved < {min_resolved} THEN '{V.DRIFT_INSUFFICIENT}' "
        f"WHEN observed_fpr > {float(tolerance)!r}D THEN '{V.DRIFT}' ELSE '{V.DRIFT_OK}' END AS label",
    )


def drift_tasks(rates: DataFrame, tolerance: float, as_of: datetime) -> DataFrame:
    """A review task for each drifting assay; its id is fixed per assay and day."""
    action = text.task_action("assay_name", "n_false_positive", "n_resolved", "observed_fpr", tolerance)
    return rates.where(f"label = '{V.DRIFT}'").selectExpr(
        f"{text.task_id('assay_name', as_of)} AS task_id",
        "assay_name", "observed_fpr", "n_resolved", "n_false_positive",
        f"{float(tolerance)!r}D AS tolerance",
        f"'{V.OPEN}' AS status",
        f"{action} AS suggested_action",
        f"{text.stamp(as_of)} AS opened_ts",
    )


def upsert_tasks(tasks: DataFrame, found: DataFrame) -> DataFrame:
    """Tasks refreshed by id and opened again; a known task keeps its tolerance."""
    both = tasks.alias("o").join(found.alias("n"), F.expr("o.task_id = n.task_id"), "full_outer")
    kept = ("task_id", "assay_name", "tolerance")
    return both.selectExpr(*[
        f"CASE WHEN o.task_id IS NOT NULL THEN o.{f.name} ELSE n.{f.name} END AS {f.name}"
        if f.name in kept else
        f"CASE WHEN n.task_id IS NOT NULL THEN n.{f.name} ELSE o.{f.name} END AS {f.name}"
        for f in REVIEW_TASK
    ])


def drift_check(
    resolved: DataFrame,
    tasks: DataFrame,
    as_of: datetime,
    tolerance: float = V.DRIFT_TOLERANCE,
    min_resolved: int = V.DRIFT_MIN_RESOLVED,
) -> tuple[DataFrame, DataFrame]:
    """(rates per assay, next task snapshot)."""
    rates = drift_rates(resolved, tolerance, min_resolved)
    return rates, upsert_tasks(tasks, drift_tasks(rates, tolerance, as_of))
