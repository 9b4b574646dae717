"""Column-major result sets and typed-cell rows as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators.spread import number_rows
from ..schemas import OBSERVATION, RESULT_SET
from .coerce import to_declared
from .lines import Kind, land_lines, parse_lines, read_lines, split_lines


#: A landed result set needs its column list and its rows; no rows are fine.
RESULT_LINE = Kind(RESULT_SET, (("no_columns", "parsed.columns IS NULL"), ("no_rows", "parsed.rows IS NULL")))


def parse_result_sets(raw: DataFrame, body: str = "body") -> DataFrame:
    """One text column of result sets to one parsed set per row; what can't be read is in :func:`rejected_result_sets`."""
    return split_lines(parse_lines(raw.select(body), RESULT_LINE, body))[0].withColumnRenamed("parsed", "rs")


def rejected_result_sets(raw: DataFrame, body: str = "body") -> DataFrame:
    """The lines that :func:`parse_result_sets` leaves out, with the reason."""
    return split_lines(parse_lines(raw, RESULT_LINE, body))[1]


def read_result_sets(spark: SparkSession, path: str) -> DataFrame:
    return parse_result_sets(read_lines(spark, path))


def land_result_sets(spark: SparkSession, path: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(result sets, rejects) of landed files, parsed once and written to ``folder``."""
    good, rejects = land_lines(spark, path, RESULT_LINE, folder)
    return good.withColumnRenamed("parsed", "rs"), rejects


def result_rows(result_sets: DataFrame, names: Sequence[str]) -> DataFrame:
    """``columns[]`` + ``rows[][]`` to one row each, cells picked by column name.

    Rows that are shorter or longer than the column list keep what lines up.
    """
    header = F.transform("rs.columns", lambda c: c["name"])
    rows = result_sets.select(header.alias("_names"), F.explode("rs.rows").alias("_row"))
    return rows.select([
        F.when(
            F.array_position("_names", name) > 0,
            F.try_element_at("_row", F.array_position("_names", name).cast("int")),
        ).alias(name)
        for name in names
    ])


def ingest_observations(result_sets: DataFrame) -> DataFrame:
    """Result sets to bronze observations at the declared schema."""
    return to_declared(result_rows(result_sets, OBSERVATION.fieldNames()), OBSERVATION)


def write_result_sets(
    rows: DataFrame, order: Sequence[str], page_size: int = V.OBSERVATION_PAGE_SIZE
) -> DataFrame:
    """Rows as result sets of ``page_size`` rows (columns ``page_offset``, ``body``).

    ``order`` names columns that sort the rows in a total order; the other columns, in
    their order, are the cells, all as text.
    """
    names = [c for c in rows.columns if c not in order]
    cells = F.array(*[F.col(n).cast("string") for n in names]).alias("cells")
    placed = number_rows(rows.select(*order, cells), list(order))
    offset = f"position - 1 - pmod(position - 1, {page_size})"
    # A set is bounded by the page size, so its rows can be gathered.
    sets = placed.groupBy(F.expr(offset).alias("page_offset")).agg(
        F.expr("sort_array(collect_list(struct(position, cells))) AS sorted"))
    header = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f"/{n}").alias("path")) for n in names])
    body = F.struct(header.alias("columns"), F.col("sorted.cells").alias("rows"))
    return sets.select("page_offset", F.to_json(body).alias("body"))


CELL_KINDS = ("string_value", "number_value", "bool_value")

CELL_ROW = "values array<struct<{}>>".format(", ".join(f"{k}:string" for k in CELL_KINDS))


def unwrap_cells(raw: DataFrame, body: str = "body") -> DataFrame:
    """``{"values":[{"string_value": ..}, ..]}`` or a plain JSON list to an array of text."""
    wrapped = F.from_json(body, CELL_ROW)
    cells = F.transform(
        wrapped["values"], lambda c: F.coalesce(*[c[kind] for kind in CELL_KINDS])
    )
    plain = F.from_json(body, "array<string>")
    is_plain = F.col(body).startswith("[")
    return raw.withColumn("cells", F.when(is_plain, plain).otherwise(cells))
