"""Point lookups and listings for one compound or one pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spread import number_rows


def clinical_summary(spark: SparkSession, summary: DataFrame, compound: str) -> DataFrame:
    """The public summary row of one compound, bound as a named parameter."""
    return spark.sql(
        "SELECT compound_id, correlation_state, n_adverse_obs, signal_summary "
        "FROM {summary} WHERE compound_id = :compound",
        args={"compound": compound}, summary=summary,
    )


def pair_history(spark: SparkSession, readings: DataFrame, compound: str, assay: str) -> DataFrame:
    """Readings of one compound and assay, oldest first."""
    return spark.sql(
        "SELECT assay_name, result_value, result_unit, "
        "date_format(acquired_ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS acquired_ts, qc_flag "
        "FROM {readings} WHERE compound_id = :compound AND assay_name = :assay "
        "ORDER BY {readings}.acquired_ts, {readings}.sample_id",
        args={"compound": compound, "assay": assay}, readings=readings,
    )


def history_positions(readings: DataFrame) -> DataFrame:
    """Chronological place of every reading within its compound and assay."""
    slim = readings.select("compound_id", "assay_name", "sample_id", "acquired_ts", "result_value")
    return number_rows(
        slim, ["acquired_ts", "sample_id"], group=["compound_id", "assay_name"]
    )


def latest_readings(readings: DataFrame, n: int = 3) -> DataFrame:
    """The n latest readings per compound.

    Spark cuts each group to n rows before the shuffle (window group limit), so
    a compound with most of the rows sends no more than n per input task.
    """
    latest = "PARTITION BY compound_id ORDER BY acquired_ts DESC, sample_id"
    return readings.selectExpr(
        "compound_id", "sample_id", "assay_name", "result_value", "result_unit", "acquired_ts",
        f"row_number() OVER ({latest}) AS recency",
    ).where(f"recency <= {int(n)}")


def worst_margins(flags: DataFrame, k: int = 5) -> DataFrame:
    """The k flagged readings furthest below their threshold."""
    return flags.where("is_flagged").orderBy(
        F.col("margin").asc_nulls_last(), "compound_id", "reading_id"
    ).limit(k)
