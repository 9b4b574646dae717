"""Snapshot tables, literal tables, views and JSON rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import fixed_values as V
from ..functions.text import quote
from ..schemas import CROSSWALK_SEED, THRESHOLD
from ..session import names_in, remove

# Rows that may be given in code at most; beyond that, write a table.
LITERAL_ROWS = 10_000


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return quote(value) if isinstance(value, str) else str(value)


def literal_table(spark: SparkSession, rows, schema: StructType) -> DataFrame:
    """A small table given in code, maybe empty; its size is checked, as it gets broadcast."""
    rows = list(rows)
    if len(rows) > LITERAL_ROWS:
        raise ValueError(f"{len(rows)} literal rows; write a table instead")
    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join(f"({', '.join(_literal(v) for v in row)})" for row in rows)
    typed = ", ".join(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema)
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({', '.join(schema.fieldNames())})")


def threshold_table(spark: SparkSession, rows=V.THRESHOLD_ROWS) -> DataFrame:
    """Threshold reference, one row per assay."""
    rows = list(rows)
    if len({row[0] for row in rows}) != len(rows):
        raise ValueError("the threshold reference needs one row per assay")
    return literal_table(spark, rows, THRESHOLD)


def crosswalk_table(spark: SparkSession, rows=V.CROSSWALK_ROWS) -> DataFrame:
    return literal_table(spark, rows, CROSSWALK_SEED)


def save_snapshot(
    df: DataFrame, table: str, comment: str | None = None, path: str | None = None, **properties: str
) -> DataFrame:
    """Replace a whole table with df and return the table as read back.

    The new rows may not read the table they replace, and readers may find none while it is
    written: see :func:`publish_version`.  ``path`` keeps its files outside the warehouse.
    """
    spark = df.sparkSession
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    if comment:
        spark.sql(f"COMMENT ON TABLE {table} IS {quote(comment)}")
    if properties:
        listed = ", ".join(f"{quote(key)} = {quote(value)}" for key, value in properties.items())
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({listed})")
    return spark.table(table)


DONE = "_SUCCESS"  # what Spark leaves in a folder that was written to its end


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The whole versions under a folder, oldest first."""
    found = sorted(n for n in names_in(spark, folder) if n.startswith("version="))
    return [n for n in found if DONE in names_in(spark, f"{folder.rstrip('/')}/{n}")]


def publish_version(
    df: DataFrame, name: str, folder: str, comment: str | None = None, keep: int = 2, **properties: str
) -> DataFrame:
    """Replace what ``name`` stands for in one step, and return it as read back.

    The rows go to a new version under ``folder`` first.  Only then one catalogue call points ``name``, a view, at
    them, with comment and properties; so readers see the old rows or the new ones, never none, and a
    write that fails changes nothing.  df may read the version that it replaces, and its columns may
    differ.  The newest ``keep`` versions stay for readers that are under way, older ones are deleted.
    One publisher at a time.
    """
    spark, folder = df.sparkSession, folder.rstrip("/")
    before = versions(spark, folder)
    number = int(before[-1].removeprefix("version=").split("-")[0]) + 1 if before else 0
    path = f"{folder}/version={number:08d}-{uuid.uuid4().hex[:8]}"
    try:
        df.write.parquet(path)
    except Exception:
        remove(spark, path)
        raise
    told = f" COMMENT {quote(comment)}" if comment else ""
    if properties:
        told += f" TBLPROPERTIES ({', '.join(f'{quote(key)} = {quote(value)}' for key, value in properties.items())})"
    spark.sql(f"CREATE OR REPLACE VIEW {name}{told} AS SELECT * FROM parquet.`{path}`")
    stay = {*versions(spark, folder)[-max(1, keep):]}
    for old in names_in(spark, folder):
        if old.startswith("version=") and old not in stay:
            remove(spark, f"{folder}/{old}")
    return spark.table(name)


def table_notes(spark: SparkSession, table: str) -> dict[str, str]:
    """A table's properties, and its comment under ``comment``."""
    notes = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    for row in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect():
        if row.col_name == "Comment":
            notes["comment"] = row.data_type
    return notes


def save_folder(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as one Parquet snapshot folder and return it as read back."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object; timestamps as ISO text, nulls kept."""
    options = {
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
        "ignoreNullFields": "false",
    }
    return df.select(F.to_json(F.struct(*df.columns), options).alias(name))
