"""Triage figures: convergence, cycle times, outcome mix, flags per assay."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import stamp
from .review_queue import open_rows
from .rollup import compound_totals
from .spread import exact_percentiles


def elapsed_seconds(start: str, end: str) -> str:
    """SQL for the seconds between two wall-clock times, fractions kept."""
    return f"timestampdiff(MICROSECOND, {start}, {end}) / 1e6D"


def hours(seconds: str) -> str:
    return f"round({seconds} / 3600, 2)"


def rate(part: str, whole: str) -> str:
    """SQL for part / whole to four decimals, NULL on an empty whole."""
    return f"round(try_divide({part}, {whole}), 4)"


def convergence(queue: DataFrame) -> DataFrame:
    """How many open compounds also carry a clinical signal; each counts once."""
    state = f"coalesce(clinical_correlation_state, '{V.NO_MAPPING}')"
    counts = compound_totals(queue).agg(
        F.expr("count(1) AS compounds_open"),
        *[F.expr(f"count_if({state} = '{s}') AS {s}") for s in (V.CORRELATED, V.CHECKED, V.NO_MAPPING)],
    )
    return counts.selectExpr(
        "*",
        f"{rate(V.CORRELATED, 'compounds_open')} AS convergence_rate",
        f"{rate(V.CORRELATED, f'{V.CORRELATED} + {V.CHECKED}')} AS correlation_rate_of_mapped",
    )


def outcome_counts(resolved: DataFrame) -> DataFrame:
    return resolved.agg(
        F.expr("count(1) AS resolved_count"),
        *[F.expr(f"count_if(resolution_reason = '{r}') AS {r}") for r in V.RESOLUTION_REASONS],
    )


def cycle_times(resolved: DataFrame, approximate: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Median and 90th percentile of seconds from flag to resolution.

    Rows without a flag time are left out.  Exact by default; ``approximate``
    trades a relative rank error of 1/accuracy for a single pass.
    """
    timed = resolved.where("flagged_ts IS NOT NULL").selectExpr(
        f"{elapsed_seconds('flagged_ts', 'resolved_ts')} AS seconds")
    points = {"median_seconds": 0.5, "p90_seconds": 0.9}
    if approximate:
        return timed.agg(*[
            F.expr(f"percentile_approx(seconds, {p}D, {accuracy}) AS {name}") for name, p in points.items()
        ])
    return exact_percentiles(timed, "seconds", points)


def triage_kpis(resolved: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: resolved count, cycle times, outcome mix, false-positive rate."""
    times = cycle_times(resolved, approximate)
    both = outcome_counts(resolved).withColumns({
        name: times.select(name).scalar() for name in ("median_seconds", "p90_seconds")
    })
    return both.selectExpr(
        "*",
        f"{hours('median_seconds')} AS median_hours",
        f"{hours('p90_seconds')} AS p90_hours",
        f"{rate(V.FALSE_POSITIVE, 'resolved_count')} AS false_positive_rate",
    )


def outcome_mix(resolved: DataFrame) -> DataFrame:
    """Share of each resolution reason in percent of all resolutions."""
    mix = resolved.groupBy("resolution_reason").agg(F.expr("count(1) AS n"))
    return mix.withColumn("percent", F.col("n") * 100 / mix.agg(F.sum("n")).scalar())


def cycle_by_outcome(resolved: DataFrame) -> DataFrame:
    """Mean hours from flag to resolution per resolution reason."""
    seconds = elapsed_seconds("flagged_ts", "resolved_ts")
    return resolved.where("flagged_ts IS NOT NULL").groupBy("resolution_reason").agg(
        F.expr("count(1) AS n"), F.expr(f"avg({seconds}) / 3600 AS mean_hours"))


def trailing_days(df: DataFrame, ts: str, days: int, as_of: datetime) -> DataFrame:
    return df.where(f"{ts} >= {stamp(as_of)} - make_dt_interval({int(days)})")


def flags_by_assay(queue: DataFrame, days: int, as_of: datetime) -> DataFrame:
    """Open flags per assay in the last days, with the grand total and the bar
    length relative to the largest assay."""
    counts = trailing_days(open_rows(queue), "flagged_ts", days, as_of).groupBy("assay_name").agg(
        F.expr("count(1) AS open_flags"))
    total = counts.agg(F.sum("open_flags")).scalar()
    largest = counts.agg(F.expr("greatest(1, max(open_flags))")).scalar()
    return counts.withColumns({
        "total_flags": total, "percent_of_largest": F.col("open_flags") * 100 / largest,
    }).orderBy(F.col("open_flags").desc(), "assay_name")


def top_with_ties(counts: DataFrame, count: str) -> DataFrame:
    """The groups holding the highest count; several where they tie."""
    return counts.where(F.col(count) == counts.agg(F.max(count)).scalar())
