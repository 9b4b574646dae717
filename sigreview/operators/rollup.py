"""Compound-level roll-up of the open queue, in blended risk order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decide
from .review_queue import open_rows
from .spread import number_rows

READING_FIELDS = (
    "reading_id", "assay_name", "result_value", "result_unit", "concern_direction", "threshold",
    "threshold_unit", "margin", "compound_prior_n", "compound_prior_mean", "reason",
)

# Readings in one row.  The n-th reading of a compound is in part (n - 1) div READINGS_PER_PART + 1.
READINGS_PER_PART = 1000


def compound_totals(queue: DataFrame) -> DataFrame:
    """Open flags, worst breach and clinical facts per compound."""
    state = "clinical_correlation_state"
    top = f"max(CASE WHEN {state} IS NOT NULL THEN {decide.state_rank(state)} END)"
    return open_rows(queue).groupBy("compound_id").agg(
        F.expr("count(1) AS open_flags"),
        F.expr("max(abs(margin)) AS worst_breach"),
        F.expr(f"{decide.state_of_rank(top)} AS clinical_correlation_state"),
        F.expr("max(clinical_drug_code) AS clinical_drug_code"),
        F.expr("max(clinical_signal_detail) AS clinical_signal_detail"),
        F.expr(f"coalesce({top}, 0) AS clinical_rank"),
    )


RISK_ORDER = ("clinical_rank DESC", "open_flags DESC", "worst_breach DESC", "compound_id")


def risk_positions(queue: DataFrame) -> DataFrame:
    """One row per open compound with its place in the blended risk order:
    clinical rank, then number of flags, then worst breach."""
    return number_rows(compound_totals(queue), RISK_ORDER)


def queue_rollup(queue: DataFrame, per_part: int = READINGS_PER_PART) -> DataFrame:
    """The compounds in risk order with their readings nested, widest breach first.

    A compound has a row for each ``per_part`` readings, numbered by ``part``."""
    return risk_positions(queue).join(
        rollup_readings(queue, per_part).drop("open_flags"), "compound_id")


def rollup_readings(queue: DataFrame, per_part: int = READINGS_PER_PART) -> DataFrame:
    """The readings nested under each compound, widest breach first.

    A compound's list comes in parts of ``per_part`` readings, numbered from 1,
    so a compound of any size stays whole without one outsized row.  Up to
    ``per_part`` readings that is one row holding the whole list.
    """
    placed = number_rows(
        open_rows(queue).select("compound_id", *READING_FIELDS),
        ["abs(margin) DESC NULLS FIRST", "reading_id", "assay_name"], group=["compound_id"], group_size="open_flags",
    ).selectExpr("*", f"CAST(floor((position - 1) / {per_part}) + 1 AS INT) AS part")
    fields = ", ".join(("position", *READING_FIELDS))
    return placed.groupBy("compound_id", "part").agg(
        F.expr("max(open_flags) AS open_flags"),
        F.expr(f"array_sort(collect_list(struct({fields}))) AS readings"),
    )


def share_of_worst(rollup: DataFrame) -> DataFrame:
    """Worst breach as percent of the largest one in the list (at least 1)."""
    largest = rollup.agg(F.expr("greatest(1.0D, max(worst_breach))")).scalar()
    return rollup.withColumn("percent_of_worst", F.col("worst_breach") * 100 / largest)
