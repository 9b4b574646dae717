"""Coercion of staged columns to a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def to_declared(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast to the declared types and order; text that does not fit becomes NULL.

    Key columns are relaxed to nullable: a missing key is for the quality gate.
    """
    have = {field.name: field.dataType for field in df.schema}
    return df.select([
        F.col(f.name) if have.get(f.name) == f.dataType
        else F.col(f.name).try_cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
