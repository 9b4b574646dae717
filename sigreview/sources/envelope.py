"""Vendor reading pages: nested JSON envelope to typed rows, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import parse
from ..functions.text import quote
from ..operators.spread import number_rows
from ..schemas import OBJECT_LIST, READING, READING_PAGE
from .coerce import to_declared
from .lines import Kind, land_lines, parse_lines, read_lines, split_lines


#: A landed page: without the envelope or its list of records it is rejected, an empty list is fine.
PAGE_LINE = Kind(READING_PAGE, (
    ("no_envelope", "parsed.LIMS_EXPORT IS NULL"),
    ("no_records", "parsed.LIMS_EXPORT.resultSet.records IS NULL"),
))


def parse_pages(raw: DataFrame, body: str = "body") -> DataFrame:
    """One text column of page JSON to one parsed page per row; what can't be read is in :func:`rejected_pages`."""
    return split_lines(parse_lines(raw.select(body), PAGE_LINE, body))[0].withColumnRenamed("parsed", "page")


def rejected_pages(raw: DataFrame, body: str = "body") -> DataFrame:
    """The lines that :func:`parse_pages` leaves out, with the reason."""
    return split_lines(parse_lines(raw, PAGE_LINE, body))[1]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page files, one JSON page per line, read as parsed pages."""
    return parse_pages(read_lines(spark, path))


def land_pages(spark: SparkSession, path: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of landed page files, parsed once and written to ``folder``."""
    good, rejects = land_lines(spark, path, PAGE_LINE, folder)
    return good.withColumnRenamed("parsed", "page"), rejects


def page_index(pages: DataFrame, *keep: str) -> DataFrame:
    """Offsets and counts stated by each page."""
    result = "page.LIMS_EXPORT.resultSet"
    return pages.select(
        F.col(f"{result}.offset").alias("page_offset"),
        F.col(f"{result}.returned").alias("returned"),
        F.col(f"{result}.nextOffset").alias("next_offset"),
        F.col(f"{result}.totalCount").alias("total_count"),
        F.coalesce(F.size(f"{result}.records"), F.lit(0)).cast("bigint").alias("n_records"),
        *keep,
    )


def missing_pages(pages: DataFrame) -> DataFrame:
    """Offsets some page points to but that were not landed: a gap in the paging."""
    index = page_index(pages)
    expected = index.where(F.col("next_offset").isNotNull()).select(
        F.col("next_offset").alias("page_offset")
    )
    return expected.join(index.select("page_offset"), "page_offset", "left_anti").distinct()


def vendor_records(pages: DataFrame) -> DataFrame:
    """Vendor records of all pages; a page without the path gives no rows."""
    return pages.select(F.explode("page.LIMS_EXPORT.resultSet.records").alias("record"))


def unmarshal(records: DataFrame, record: str = "record") -> DataFrame:
    """Vendor record to the 13 declared columns; what is missing becomes NULL."""
    sample = f"{record}.smpl"
    typed = {
        "sample_id": sample,
        "compound_id": parse.sample_compound(sample),
        "plate": parse.sample_plate(sample),
        "well": parse.sample_well(sample),
        "replicate": parse.sample_replicate(sample),
        "assay_name": f"{record}.analyte",
        "result_value": parse.lenient_number(f"{record}.meas.val"),
        "result_unit": f"{record}.meas.uom",
        "acquired_ts": parse.vendor_timestamp(f"{record}.acqTs"),
        "assay_protocol": f"{record}.proto",
        "operator_id": f"{record}.operator",
        "batch_guid": f"{record}.batchGuid",
        "qc_flag": f"{record}.qcFlag",
    }
    return records.selectExpr(*[f"{sql} AS {name}" for name, sql in typed.items()])


def ingest_readings(pages: DataFrame) -> DataFrame:
    """Parsed pages to bronze readings at the declared schema."""
    return to_declared(unmarshal(vendor_records(pages)), READING)


def list_objects(raw: DataFrame, body: str = "body") -> DataFrame:
    """Catalogue envelope to object names and record counts."""
    parsed = raw.select(F.from_json(body, OBJECT_LIST).alias("catalogue"))
    return parsed.select(F.explode("catalogue.LIMS_EXPORT.objects").alias("o")).select(
        F.col("o.name").alias("name"), F.col("o.recordCount").alias("record_count")
    )


# Reading columns as the vendor's nested record of strings.
_RECORD = (
    "named_struct('smpl', sample_id, 'analyte', assay_name, "
    "'meas', named_struct('val', CAST(result_value AS STRING), 'uom', result_unit), "
    f"'acqTs', {parse.vendor_timestamp_text('acquired_ts')}, 'proto', assay_protocol, "
    "'operator', operator_id, 'batchGuid', batch_guid, 'qcFlag', qc_flag)"
)


def write_envelopes(
    readings: DataFrame,
    *,
    order: Sequence[str] = ("sample_id", "assay_name"),
    page_size: int = V.READING_PAGE_SIZE,
    object_name: str = "assay_results",
    exported_at: str = "20260914 09:00:00.000",
) -> DataFrame:
    """Readings to page envelopes (columns ``page_offset``, ``body``), in a fixed order.

    ``order`` must be a total order, so pages come out the same on every run.
    """
    slim = readings.selectExpr(*order, f"{_RECORD} AS record")
    paged = number_rows(slim, list(order), name="position", group_size="total").selectExpr(
        f"position - 1 - pmod(position - 1, {page_size}) AS page_offset", "position", "total", "record")
    # A page is bounded by its size, so its records can be gathered in one row.
    pages = paged.groupBy("page_offset").agg(
        F.expr("max(total) AS total"),
        F.expr("sort_array(collect_list(struct(position, record))) AS sorted"),
    )
    following = "page_offset + size(sorted)"
    result_set = (
        "named_struct('totalCount', total, 'returned', CAST(size(sorted) AS BIGINT), "
        f"'offset', page_offset, 'nextOffset', CASE WHEN {following} < total THEN {following} END, "
        "'records', transform(sorted, r -> r.record))"
    )
    envelope = (
        f"named_struct('exportedAt', {quote(exported_at)}, 'object', {quote(object_name)}, "
        f"'resultSet', {result_set})"
    )
    return pages.selectExpr("page_offset", f"to_json(named_struct('LIMS_EXPORT', {envelope})) AS body")
