"""The two table-reading scalar functions, for use in spark.sql.

Each is defined over views that hold one row per key: the history of a pair, the rule of
an assay, the mapping of a compound, its adverse observations.  The views come from the operators
that answer for whole tables, so a function and its batch form share every number, and a call costs
one lookup per view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import correlate, scoring
from . import decide

# Rows found in the views, and what the functions return.
_RULE = "direction STRING, threshold DOUBLE, unit STRING, synthetic BOOLEAN"
_PAST = "readings BIGINT, mean DOUBLE"
_MAPPING = "drug_code STRING, confidence DOUBLE"
_ADVERSE = "observations BIGINT, terms STRING"
_VERDICT = (
    "is_flagged BOOLEAN, assay_name STRING, reading_value DOUBLE, reading_unit STRING, "
    "concern_direction STRING, threshold DOUBLE, threshold_unit STRING, margin DOUBLE, "
    "compound_prior_n BIGINT, compound_prior_mean DOUBLE, is_synthetic_reference BOOLEAN, "
    "reason STRING"
)
_SIGNAL = (
    "state STRING, drug_code STRING, crosswalk_confidence DOUBLE, n_adverse_obs BIGINT, "
    "signal_detail STRING"
)


def _function(spark: SparkSession, name: str, takes: str, returns: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS STRUCT<{returns}> RETURN {body}")


def _looked_up(view: str, keys: dict[str, str], fields: dict[str, str]) -> str:
    """SQL for the row of a view with one row per key, as a struct; NULL where there is none."""
    row = ", ".join(f"'{name}', {column}" for name, column in fields.items())
    match = " AND ".join(f"{view}.{column} = {argument}" for column, argument in keys.items())
    return f"(SELECT any_value(named_struct({row})) FROM {view} WHERE {match})"


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in fields.items()) + ")"


def _rows(spark: SparkSession, table: str | DataFrame) -> DataFrame:
    return spark.table(table) if isinstance(table, str) else table


def register_check_reading(
    spark: SparkSession, readings: str | DataFrame, reference: str | DataFrame,
    name: str = "check_reading", past: DataFrame | None = None,
) -> None:
    """``name(compound, assay, value, unit)`` returns the explained verdict as a struct.

    Tables are given by name or as such; ``reference`` has one row per assay.  ``past`` is a
    written history; by default it is that of ``readings``.
    """
    past = scoring.history(_rows(spark, readings)) if past is None else past
    past.createOrReplaceTempView(f"{name}_past")
    _rows(spark, reference).createOrReplaceTempView(f"{name}_rules")
    value, direction, threshold = "value", "rule.direction", "rule.threshold"
    told, counted = f"round(coalesce(past.mean, {value}), 4)", "coalesce(past.readings, 0L)"
    _function(
        spark, f"{name}_told", f"assay STRING, value DOUBLE, unit STRING, rule STRUCT<{_RULE}>, past STRUCT<{_PAST}>",
        _VERDICT, _struct({
            "is_flagged": decide.breaches(value, direction, threshold), "assay_name": "assay",
            "reading_value": value, "reading_unit": "unit", "concern_direction": direction,
            "threshold": threshold, "threshold_unit": "rule.unit", "margin": decide.margin(value, threshold),
            "compound_prior_n": counted, "compound_prior_mean": "round(past.mean, 4)",
            "is_synthetic_reference": "coalesce(rule.synthetic, FALSE)",
            "reason": decide.reason("assay", value, "unit", direction, threshold, "rule.unit", told, counted)}))
    rule = _looked_up(f"{name}_rules", {"assay_name": f"{name}.assay"}, {
        "direction": "concern_direction", "threshold": "concern_threshold", "unit": "unit", "synthetic": "is_synthetic"})
    known = _looked_up(f"{name}_past", {"compound_id": f"{name}.compound", "assay_name": f"{name}.assay"}, {
        "readings": "prior_n", "mean": "prior_mean"})
    _function(spark, name, "compound STRING, assay STRING, value DOUBLE, unit STRING", _VERDICT,
              f"{name}_told({name}.assay, {name}.value, {name}.unit, {rule}, {known})")


def register_check_signal(
    spark: SparkSession, crosswalk: str | DataFrame, observations: str | DataFrame,
    name: str = "check_signal",
) -> None:
    """``name(compound)`` returns the three-state clinical signal as a struct."""
    crosswalk, observations = _rows(spark, crosswalk), _rows(spark, observations)
    correlate.collapse_crosswalk(crosswalk).createOrReplaceTempView(f"{name}_mapping")
    correlate.adverse_by_compound(crosswalk, observations).createOrReplaceTempView(f"{name}_adverse")
    drug, n = "mapping.drug_code", "adverse.observations"
    _function(
        spark, f"{name}_told", f"mapping STRUCT<{_MAPPING}>, adverse STRUCT<{_ADVERSE}>", _SIGNAL, _struct({
            "state": decide.signal_state(drug, n), "drug_code": drug,
            "crosswalk_confidence": "mapping.confidence", "n_adverse_obs": f"coalesce({n}, 0L)",
            "signal_detail": decide.signal_detail(drug, n, "adverse.terms")}))
    mapping = _looked_up(f"{name}_mapping", {"compound_id": f"{name}.compound"}, {
        "drug_code": "drug_code", "confidence": "crosswalk_confidence"})
    adverse = _looked_up(f"{name}_adverse", {"compound_id": f"{name}.compound"}, {
        "observations": "n_adverse", "terms": "terms"})
    _function(spark, name, "compound STRING", _SIGNAL, f"{name}_told({mapping}, {adverse})")
