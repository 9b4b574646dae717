"""Score readings against the threshold reference, with the history of the pair."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decide
from ..functions.text import stamp
from ..schemas import table
from .spread import HOT_ROWS, join_dimension, join_unique


def stable_mean(value: str) -> str:
    """SQL for a mean through an exact decimal sum: row order cannot change it.

    Values a decimal cannot hold (NaN, infinities, beyond 10^15) fall back to
    the floating mean.
    """
    exact = f"TRY_CAST({value} AS DECIMAL(24, 9))"
    return (
        f"CASE WHEN count({exact}) = count({value}) "
        f"THEN CAST(sum({exact}) AS DOUBLE) / count({value}) ELSE avg({value}) END"
    )


def history(readings: DataFrame) -> DataFrame:
    """Count and mean per (compound, assay) over all readings of the pair."""
    return readings.groupBy("compound_id", "assay_name").agg(
        F.expr("count(1) AS prior_n"), F.expr(f"{stable_mean('result_value')} AS prior_mean")
    )


# What is kept of a pair so that its mean can be taken later: rows, values, those an exact decimal holds, both sums.
PARTIAL = table(
    "compound_id string, assay_name string, n_rows bigint, n_values bigint, n_exact bigint, exact_sum decimal(38,9), plain_sum double"
)


def history_parts(readings: DataFrame) -> DataFrame:
    """Mergeable sums per (compound, assay), in the columns of ``PARTIAL``."""
    exact = "TRY_CAST(result_value AS DECIMAL(24, 9))"
    return readings.groupBy("compound_id", "assay_name").agg(
        F.expr("count(1) AS n_rows"), F.expr("count(result_value) AS n_values"), F.expr(f"count({exact}) AS n_exact"),
        F.expr(f"CAST(sum({exact}) AS DECIMAL(38, 9)) AS exact_sum"), F.expr("sum(result_value) AS plain_sum"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """Parts of several runs as one row per pair; the order of merging makes no difference to exact sums."""
    counts = [F.expr(f"sum({n}) AS {n}") for n in ("n_rows", "n_values", "n_exact")]
    return parts.groupBy("compound_id", "assay_name").agg(
        *counts, F.expr("CAST(sum(exact_sum) AS DECIMAL(38, 9)) AS exact_sum"), F.expr("sum(plain_sum) AS plain_sum"))


def history_of_parts(parts: DataFrame) -> DataFrame:
    """The history that merged parts stand for, as :func:`history` gives it."""
    mean = "CASE WHEN n_exact = n_values THEN CAST(exact_sum AS DOUBLE) ELSE plain_sum END"
    return parts.selectExpr("compound_id", "assay_name", "n_rows AS prior_n", f"try_divide({mean}, n_values) AS prior_mean")


def with_reference(readings: DataFrame, reference: DataFrame, how: str = "left") -> DataFrame:
    """Readings with their assay's threshold row, which must be unique per assay."""
    slim = reference.selectExpr(
        "assay_name", "concern_direction", "concern_threshold AS threshold",
        "unit AS threshold_unit", "is_synthetic",
    )
    return join_dimension(readings, slim, ["assay_name"], how, spread=["sample_id"])


def with_history(readings: DataFrame, past: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Readings with the history of their (compound, assay) pair."""
    pair = ["compound_id", "assay_name"]
    return join_unique(
        readings, past, pair, "left", spread=["sample_id", "acquired_ts"],
        weights=past.selectExpr(*pair, "prior_n AS rows"), hot_rows=hot_rows,
    )


def heavy_pairs(readings: DataFrame, hot_rows: int = HOT_ROWS) -> bool:
    """Whether some (compound, assay) has so many readings; fewer rows than that in all need no count per pair."""
    if readings.count() < hot_rows:
        return False
    return not readings.groupBy("compound_id", "assay_name").count().where(f"count >= {hot_rows}").isEmpty()


def with_own_history(readings: DataFrame) -> DataFrame:
    """Readings with the history of their pair among themselves: one scan and one shuffle by pair.

    For readings without :func:`heavy_pairs`, as a pair's readings meet in one task.
    """
    over = "OVER (PARTITION BY compound_id, assay_name)"
    exact = "TRY_CAST(result_value AS DECIMAL(24, 9))"
    mean = (f"CASE WHEN count({exact}) {over} = count(result_value) {over} "
            f"THEN CAST(sum({exact}) {over} AS DOUBLE) / count(result_value) {over} ELSE avg(result_value) {over} END")
    # As in a join, null keys have no history.
    known = "compound_id IS NOT NULL AND assay_name IS NOT NULL"
    return readings.selectExpr(
        "*", f"CASE WHEN {known} THEN count(1) {over} END AS prior_n", f"CASE WHEN {known} THEN {mean} END AS prior_mean")


def verdicts(scored: DataFrame, as_of: datetime) -> DataFrame:
    """The flag columns, from readings that carry reference and history."""
    value, direction, threshold = "result_value", "concern_direction", "threshold"
    mean, n = "round(prior_mean, 4)", "coalesce(prior_n, 0L)"
    # A pair that the history does not know: the reading itself stands in, in the text only.
    told = f"round(coalesce(prior_mean, {value}), 4)"
    why = decide.reason("assay_name", value, "result_unit", direction, threshold, "threshold_unit", told, n)
    return scored.selectExpr(
        "compound_id", "sample_id AS reading_id", "assay_name", "result_value", "result_unit",
        f"{decide.breaches(value, direction, threshold)} AS is_flagged",
        f"{why} AS reason",
        "concern_direction", "threshold", "threshold_unit",
        f"{decide.margin(value, threshold)} AS margin",
        f"{n} AS compound_prior_n",
        f"{mean} AS compound_prior_mean",
        "coalesce(is_synthetic, FALSE) AS is_synthetic_reference",
        f"{stamp(as_of)} AS evaluated_ts",
    )


def score_readings(
    readings: DataFrame,
    reference: DataFrame,
    as_of: datetime,
    past: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One explained verdict per reading; nothing is dropped.

    Nothing is written here.  A job that scores more than once, or scores an
    increment, passes the ``past`` it has written as a stage of its own.  Without it the history is that of the
    readings: taken in one scan where no pair is heavy, else by a join with heavy pairs sliced.
    """
    slim = readings.select(
        "sample_id", "compound_id", "assay_name", "result_value", "result_unit", "acquired_ts"
    )
    if past is None and not heavy_pairs(slim, hot_rows):
        return verdicts(with_own_history(with_reference(slim, reference)), as_of)
    past = history(slim) if past is None else past
    return verdicts(with_history(with_reference(slim, reference), past, hot_rows), as_of)


def flag_summary(flags: DataFrame) -> DataFrame:
    return flags.agg(
        F.expr("count(1) AS n_readings"),
        F.expr("sum(CAST(is_flagged AS INT)) AS n_flagged"),
        F.expr("count_if(NOT is_flagged) AS n_not_flagged"),
    )


def flagged_per_assay(flags: DataFrame) -> DataFrame:
    return flags.where("is_flagged").groupBy("assay_name").agg(F.expr("count(1) AS n_flagged"))
