"""Quality gate: label every row once, split on the label, reconcile the counts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import fixed_values as V
from ..functions.text import quote


@dataclass(frozen=True)
class Rule:
    """A row that meets ``broken`` (an SQL condition) is quarantined under ``label``."""

    label: str
    broken: str


READING_RULES = (
    Rule(V.NULL_COMPOUND, "compound_id IS NULL"),
    Rule(V.NULL_ASSAY, "assay_name IS NULL"),
    Rule(V.NULL_ACQUIRED, "acquired_ts IS NULL"),
    Rule(V.NULL_VALUE, "result_value IS NULL"),
    Rule(V.NONPOSITIVE_VALUE, "result_value <= 0"),
    # NaN sorts above every number, so it lands here too.
    Rule(V.VALUE_TOO_HIGH, f"result_value > {V.MAX_RESULT_VALUE!r}"),
)


def first_broken(rules: Sequence[Rule] = READING_RULES) -> str:
    """SQL for the label of the first broken rule, NULL for a good row."""
    cases = " ".join(f"WHEN {rule.broken} THEN {quote(rule.label)}" for rule in rules)
    return f"CASE {cases} END"


def label_quality(df: DataFrame, rules: Sequence[Rule] = READING_RULES) -> DataFrame:
    return df.selectExpr("*", f"{first_broken(rules)} AS quarantine_reason")


def split_quality(
    df: DataFrame, rules: Sequence[Rule] = READING_RULES
) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): exact complements, as both follow from one label."""
    labelled = label_quality(df, rules)
    valid = labelled.where("quarantine_reason IS NULL").drop("quarantine_reason")
    return valid, labelled.where("quarantine_reason IS NOT NULL")


def reconcile(df: DataFrame, rules: Sequence[Rule] = READING_RULES) -> DataFrame:
    """One row: all rows, valid rows, quarantined rows and whether they add up."""
    counts = df.selectExpr(f"{first_broken(rules)} AS label").agg(
        F.expr("count(1) AS source_rows"),
        F.expr("count_if(label IS NULL) AS valid_rows"),
        F.expr("count(label) AS quarantined_rows"),
    )
    return counts.selectExpr("*", "source_rows = valid_rows + quarantined_rows AS reconciled")


VALID = "valid"


def write_split(
    df: DataFrame, folder: str, rules: Sequence[Rule] = READING_RULES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid, quarantine, counts), written in one pass over df.

    Rows go to ``folder`` partitioned by outcome, and are counted by the same job as they pass, so the counts of
    :func:`reconcile` take no second scan.  Counting follows the rows that the job kept: tasks that were tried again or
    run twice count once.  A quarantine label must differ from ``valid``.
    """
    spark = df.sparkSession
    seen = Observation(f"gate-{uuid.uuid4().hex}")
    outcome = f"coalesce(quarantine_reason, '{VALID}') AS outcome"
    labelled = label_quality(df, rules).observe(
        seen, F.expr("count(1) AS source_rows"), F.expr("count_if(quarantine_reason IS NULL) AS valid_rows"),
        F.expr("count(quarantine_reason) AS quarantined_rows"))
    labelled.selectExpr(*df.columns, outcome).write.mode("overwrite").partitionBy("outcome").parquet(folder)
    told = seen.get
    counts = spark.sql("SELECT " + ", ".join(f"{told[n]}L AS {n}" for n in ("source_rows", "valid_rows", "quarantined_rows")))
    schema = StructType([*df.schema.fields, StructField("outcome", StringType())])
    rows = spark.read.schema(schema).parquet(folder)
    valid = rows.where(f"outcome = '{VALID}'").drop("outcome")
    quarantine = rows.where(f"outcome <> '{VALID}'").withColumnRenamed("outcome", "quarantine_reason")
    return valid, quarantine, counts.selectExpr("*", "source_rows = valid_rows + quarantined_rows AS reconciled")


def reconcile_tables(source: DataFrame, valid: DataFrame, quarantine: DataFrame) -> DataFrame:
    """The same check over three written tables, each counted on its own."""
    parts = None
    for name, df in (("source", source), ("valid", valid), ("quarantined", quarantine)):
        part = df.agg(F.expr("count(1) AS n")).selectExpr(f"'{name}' AS part", "n")
        parts = part if parts is None else parts.unionByName(part)
    wide = parts.agg(*[
        F.expr(f"max(CASE WHEN part = '{name}' THEN n END) AS {name}_rows")
        for name in ("source", "valid", "quarantined")
    ])
    return wide.selectExpr("*", "source_rows = valid_rows + quarantined_rows AS reconciled")


def bronze_profile(readings: DataFrame) -> DataFrame:
    return readings.agg(
        F.expr("count(1) AS n_rows"),
        F.expr("count(DISTINCT compound_id) AS n_compounds"),
        F.expr("count(DISTINCT assay_name) AS n_assays"),
        F.expr("min(acquired_ts) AS first_ts"),
        F.expr("max(acquired_ts) AS last_ts"),
    )


def assay_profile(readings: DataFrame) -> DataFrame:
    return readings.groupBy("assay_name").agg(
        F.expr("count(1) AS n"),
        F.expr("min(result_value) AS min_value"),
        F.expr("max(result_value) AS max_value"),
    )
