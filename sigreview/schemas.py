"""Declared schemas of the tables and of the vendor payloads."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(),
    "boolean": BooleanType(), "timestamp_ntz": TimestampNTZType(),
    "decimal(38,9)": DecimalType(38, 9),
}


def table(columns: str) -> StructType:
    """A flat schema from ``name type, ...``; a trailing ``not null`` is honoured."""
    fields = []
    for column in columns.split(", "):
        name, kind, *rest = column.split()
        fields.append(StructField(name, _TYPES[kind], rest != ["not", "null"]))
    return StructType(fields)


READING = table(
    "sample_id string not null, compound_id string, plate string, well string, replicate int, "
    "assay_name string, result_value double, result_unit string, acquired_ts timestamp_ntz, "
    "assay_protocol string, operator_id string, batch_guid string, qc_flag string"
)
READING_KEY = ("sample_id", "assay_name")
READING_CURSOR = "acquired_ts"

# A reading id may occur in several assays, so queue, log and actions go by both.
QUEUE_KEY = ("reading_id", "assay_name")

OBSERVATION = table(
    "patient_ref string not null, drug_code string, observation_type string, value string, "
    "effective_ts timestamp_ntz"
)
OBSERVATION_KEY = ("patient_ref", "drug_code", "observation_type", "effective_ts")
OBSERVATION_CURSOR = "effective_ts"

THRESHOLD = table(
    "assay_name string, concern_direction string, concern_threshold double, unit string, "
    "rationale string, is_synthetic boolean"
)

CROSSWALK_SEED = table(
    "compound_id string, drug_code string, mapping_source string, confidence double"
)

VENDOR_RECORD = (
    "struct<smpl:string, analyte:string, meas:struct<val:string, uom:string>, acqTs:string, "
    "proto:string, operator:string, batchGuid:string, qcFlag:string>"
)
# Payload schemas stay as DDL text, which from_json and the readers take as is.
READING_PAGE = (
    "LIMS_EXPORT struct<exportedAt:string, object:string, resultSet:struct<totalCount:bigint, "
    f"returned:bigint, offset:bigint, nextOffset:bigint, records:array<{VENDOR_RECORD}>>>"
)
OBJECT_LIST = (
    "LIMS_EXPORT struct<objects:array<struct<name:string, recordCount:bigint>>>"
)
RESULT_SET = (
    "columns array<struct<name:string, path:string>>, rows array<array<string>>"
)

QUEUE = table(
    "reading_id string, compound_id string, assay_name string, result_value double, "
    "result_unit string, concern_direction string, threshold double, threshold_unit string, "
    "margin double, compound_prior_n bigint, compound_prior_mean double, reason string, "
    "status string, flagged_ts timestamp_ntz, synced_ts timestamp_ntz, resolved_by string, "
    "resolved_ts timestamp_ntz, resolution_note string, resolution_reason string, "
    "clinical_correlation_state string, clinical_drug_code string, clinical_signal_detail string"
)

RESOLVED_ITEM = table(
    "reading_id string, compound_id string, assay_name string, result_value double, "
    "result_unit string, threshold double, margin double, reason string, "
    "resolution_reason string, resolved_by string, resolved_ts timestamp_ntz, "
    "flagged_ts timestamp_ntz, resolution_note string"
)

ACTION = table(
    "reading_id string, assay_name string, seq bigint, action string, resolution_reason string, actor string, "
    "action_ts timestamp_ntz, note string"
)

REPLY = table("prompt_hash string, model_endpoint string, recommendation string")

REVIEW_TASK = table(
    "task_id string, assay_name string, observed_fpr double, n_resolved bigint, "
    "n_false_positive bigint, tolerance double, status string, suggested_action string, "
    "opened_ts timestamp_ntz"
)
