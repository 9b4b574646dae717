"""The named questions as SQL table functions, for use in ``spark.sql``, also per row by LATERAL.

A function is defined over views of the tables it asks, and over the views of the questions that take no
argument, so it states no rule of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import questions


def _function(spark: SparkSession, name: str, takes: str, df: DataFrame, body: str) -> None:
    returns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    columns = ", ".join(df.columns)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE ({returns}) RETURN SELECT {columns} FROM {body}")


def register_questions(
    spark: SparkSession, readings: DataFrame, flags: DataFrame, reference: DataFrame, registry: DataFrame, summary: DataFrame,
    prefix: str = "",
) -> list[str]:
    """Create the eleven functions, named as in ``plans/questions.py`` with ``prefix`` in front; their names.

    ``last_readings(compound, n)`` with n = 3, ``flagged_in_assay(assay, below)`` with no limit, and
    ``average_per_compound(assay)`` take arguments; the others none.  A NULL compound asks for all, as in Python.
    """
    made: list[str] = []

    def view(name: str, df: DataFrame) -> str:
        df.createOrReplaceTempView(f"{prefix}{name}_asked")
        return f"{prefix}{name}_asked"

    def question(name: str, df: DataFrame, takes: str = "", where: str = "") -> None:
        made.append(f"{prefix}{name}")
        own = where.format(me=made[-1])
        _function(spark, made[-1], takes, df, view(name, df) + (f" WHERE {own}" if own else ""))

    question("currently_flagged", questions.currently_flagged(flags))
    question("against_threshold", questions.against_threshold(readings, reference))
    question("most_flagged_assay", questions.most_flagged_assay(flags))
    question("registry_size", questions.registry_size(registry))
    question("concern_thresholds", questions.concern_thresholds(reference))
    question("correlated_compounds", questions.correlated_compounds(summary))
    question("compounds_per_state", questions.compounds_per_state(summary))
    question("unmapped_compounds", questions.unmapped_compounds(summary))
    # The arguments stand outside the views, where LATERAL can correlate them.
    placed = readings.selectExpr(
        "compound_id", "sample_id", "assay_name", "result_value", "result_unit", "acquired_ts",
        "row_number() OVER (PARTITION BY compound_id ORDER BY acquired_ts DESC, sample_id) AS recency")
    question("last_readings", placed, "compound STRING DEFAULT NULL, n INT DEFAULT 3",
             "recency <= {me}.n AND ({me}.compound IS NULL OR compound_id = {me}.compound)")
    flagged = flags.where("is_flagged").select("compound_id", "reading_id", "result_value", "margin", "assay_name")
    made.append(f"{prefix}flagged_in_assay")
    _function(spark, made[-1], "assay STRING, below DOUBLE DEFAULT NULL", flagged.drop("assay_name"),
              f"{view('flagged_in_assay', flagged)} WHERE assay_name = {made[-1]}.assay "
              f"AND ({made[-1]}.below IS NULL OR result_value < {made[-1]}.below)")
    means = readings.groupBy("compound_id", "assay_name").agg(F.expr("avg(result_value) AS mean_value"), F.expr("count(1) AS n"))
    made.append(f"{prefix}average_per_compound")
    _function(spark, made[-1], "assay STRING", means.drop("assay_name"),
              f"{view('average_per_compound', means)} WHERE assay_name = {made[-1]}.assay")
    return made
