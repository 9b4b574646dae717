"""Landed lines of JSON: each is parsed once and is either good or rejected with a reason, never lost.

A kind of line has a schema and checks, the reasons for which a parsed line is rejected.  The parts of
:func:`parse_lines` add up to the lines that were landed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quote

BLANK_LINE, UNREADABLE = "blank_line", "unreadable_json"

# Where a written line belongs if nothing is wrong with it.
GOOD = "good"

_CORRUPT = "_corrupt"


@dataclass(frozen=True)
class Kind:
    """``schema`` is DDL text of a line's fields; ``checks`` are (reason, SQL over ``parsed``), the first that holds counts."""

    schema: str
    checks: tuple[tuple[str, str], ...]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of landed files as ``body``, each with its ``source_file``."""
    return _lines(spark.read.text(path))


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same of files as they are landed."""
    return _lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("source_file"))


def parse_lines(raw: DataFrame, kind: Kind, body: str = "body") -> DataFrame:
    """``raw`` with ``parsed`` (NULL where rejected) and ``reject_reason`` (NULL where good).

    A line is unreadable if any part of it doesn't fit the schema: what could be read of such a line
    is not used, as it can't be told what is missing.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    read = raw.withColumn("parsed", F.from_json(body, f"{kind.schema}, {_CORRUPT} string", options))
    cases = [(BLANK_LINE, f"coalesce(trim({body}), '') = ''"), (UNREADABLE, f"parsed IS NULL OR parsed.{_CORRUPT} IS NOT NULL"), *kind.checks]
    reason = "CASE " + " ".join(f"WHEN {sql} THEN {quote(name)}" for name, sql in cases) + " END"
    labelled = read.withColumn("reject_reason", F.expr(reason))
    whole = F.col("parsed").dropFields(_CORRUPT)
    return labelled.withColumn("parsed", F.when(F.col("reject_reason").isNull(), whole))


def split_lines(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): parsed lines, and raw lines with their reason.  Over a plan that isn't written each parses for itself."""
    return parsed.where("reject_reason IS NULL").select("parsed"), parsed.where("reject_reason IS NOT NULL").drop("parsed")


def _outcomes(parsed: DataFrame) -> DataFrame:
    """Rows to be written by outcome; a good line's text is not kept beside what was read from it."""
    kept = F.when(F.col("reject_reason").isNotNull(), F.col("body")).alias("body")
    return parsed.select("parsed", kept, "source_file", F.coalesce("reject_reason", F.lit(GOOD)).alias("outcome"))


def land_lines(spark: SparkSession, path: str, kind: Kind, folder: str) -> tuple[DataFrame, DataFrame]:
    """Landed files parsed once into ``folder``, partitioned by outcome; (good, rejects) as read back."""
    _outcomes(parse_lines(read_lines(spark, path), kind)).write.mode("overwrite").partitionBy("outcome").parquet(folder)
    return landed(spark, kind, folder)


def start_landing(lines: DataFrame, kind: Kind, folder: str, checkpoint: str, **trigger):
    """The same of a stream of lines: one query parses them, and both outcomes are partitions of its folder."""
    writer = _outcomes(parse_lines(lines, kind)).writeStream.format("parquet").option("path", folder).partitionBy("outcome")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def landed(spark: SparkSession, kind: Kind, folder: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of a folder that lines were landed in; each reads its own partitions."""
    schema = f"parsed struct<{_fields(kind.schema)}>, body string, source_file string, outcome string"
    rows = spark.read.schema(schema).parquet(folder)
    good: Column = F.col("outcome") == GOOD
    return rows.where(good).select("parsed"), rows.where(~good).select("body", "source_file", F.col("outcome").alias("reject_reason"))


def _fields(schema: str) -> str:
    """Top-level DDL columns as struct fields."""
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def outcome_counts(parsed: DataFrame) -> DataFrame:
    """Lines per outcome; their sum is the number of lines."""
    return parsed.groupBy(F.coalesce("reject_reason", F.lit(GOOD)).alias("outcome")).agg(F.count(F.lit(1)).alias("n_lines"))
