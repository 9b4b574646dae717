"""Named questions a reviewer asks, each resolved to a query over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators.correlate import state_counts
from ..operators.kpi import top_with_ties
from ..operators.lookups import latest_readings
from ..operators.scoring import flagged_per_assay, with_reference


def currently_flagged(flags: DataFrame) -> DataFrame:
    """Q1: which compounds are flagged now, worst margin first."""
    return flags.where("is_flagged").select(
        "compound_id", "assay_name", "result_value", "threshold", "margin", "reason"
    ).orderBy(F.col("margin").asc_nulls_last(), "compound_id")


def last_readings(readings: DataFrame, compound: str | None = None, n: int = 3) -> DataFrame:
    """Q2: the last readings of one compound, or of each."""
    rows = readings.where(F.col("compound_id") == compound) if compound else readings
    return latest_readings(rows, n)


def against_threshold(readings: DataFrame, reference: DataFrame) -> DataFrame:
    """Q3: readings beside their assay's threshold; only assays that have one."""
    return with_reference(
        readings.select("compound_id", "sample_id", "assay_name", "result_value"), reference, "inner"
    ).selectExpr(
        "compound_id", "sample_id", "assay_name", "result_value",
        "threshold AS concern_threshold", "concern_direction",
    )


def most_flagged_assay(flags: DataFrame) -> DataFrame:
    """Q4: the assay with the most flagged readings, with ties."""
    return top_with_ties(flagged_per_assay(flags), "n_flagged")


def registry_size(registry: DataFrame) -> DataFrame:
    """Q5: how many compounds the registry holds."""
    return registry.agg(F.expr("count(1) AS n_compounds"))


def concern_thresholds(reference: DataFrame) -> DataFrame:
    """Q6: the thresholds per assay."""
    return reference.select("assay_name", "concern_direction", "concern_threshold", "unit")


def flagged_in_assay(flags: DataFrame, assay: str, below: float | None = None) -> DataFrame:
    """Q7: compounds with a flagged reading in one assay, optionally below a value."""
    rows = flags.where(F.col("is_flagged") & (F.col("assay_name") == assay))
    if below is not None:
        rows = rows.where(F.col("result_value") < below)
    return rows.select("compound_id", "reading_id", "result_value", "margin")


def average_per_compound(readings: DataFrame, assay: str) -> DataFrame:
    """Q8: mean result per compound in one assay."""
    return readings.where(F.col("assay_name") == assay).groupBy("compound_id").agg(
        F.expr("avg(result_value) AS mean_value"), F.expr("count(1) AS n")
    )


def with_state(summary: DataFrame, state: str) -> DataFrame:
    return summary.where(F.col("correlation_state") == state).select("compound_id", "signal_summary")


def correlated_compounds(summary: DataFrame) -> DataFrame:
    """C1: flagged compounds with a clinical correlation."""
    return with_state(summary, V.CORRELATED)


def compounds_per_state(summary: DataFrame) -> DataFrame:
    """C2: compounds in each correlation state."""
    return state_counts(summary)


def unmapped_compounds(summary: DataFrame) -> DataFrame:
    """C3: compounds without a clinical mapping."""
    return with_state(summary, V.NO_MAPPING)
