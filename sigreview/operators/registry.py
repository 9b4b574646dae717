"""Registries: one row per key with counts and the time span it was seen in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import structure_placeholder


def registry(df: DataFrame, key: str, ts: str, dimension: str, count_as: str, dimension_as: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.expr(f"count(1) AS {count_as}"),
        F.expr(f"count(DISTINCT {dimension}) AS {dimension_as}"),
        F.expr(f"min({ts}) AS first_seen"),
        F.expr(f"max({ts}) AS last_seen"),
    )


def compound_registry(readings: DataFrame) -> DataFrame:
    seen = registry(readings, "compound_id", "acquired_ts", "assay_name", "n_readings", "n_assays")
    return seen.selectExpr(
        "compound_id",
        f"{structure_placeholder('compound_id')} AS structure_id_placeholder",
        "TRUE AS structure_is_synthetic_placeholder",
        "n_readings", "n_assays", "first_seen", "last_seen",
    )


def patient_registry(observations: DataFrame) -> DataFrame:
    return registry(
        observations, "patient_pseudonym", "effective_ts", "drug_code", "n_observations", "n_drug_codes"
    )
