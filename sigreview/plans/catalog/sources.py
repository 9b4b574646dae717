"""Scans, sources and sinks."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ...operators import quality
from ...schemas import READING
from ...session import pin, scratch_path
from ...sources import coerce, envelope, lines, resultset, tables
from .. import bindings as B
from .base import query

READING_COLUMNS = ", ".join(READING.fieldNames())


@query("s1_envelope_unnest", """
    SELECT sample_id, assay_name, CAST(result_value AS VARCHAR) AS value_text, result_unit,
      strftime(acquired_ts, '%Y%m%d %H:%M:%S.%g') AS acquired_text, assay_protocol, operator_id,
      batch_guid, qc_flag FROM bronze""")
def envelope_unnest(spark, d):
    r = "record"
    return envelope.vendor_records(B.pages(spark, d)).select(
        F.col(f"{r}.smpl").alias("sample_id"), F.col(f"{r}.analyte").alias("assay_name"),
        F.col(f"{r}.meas.val").alias("value_text"), F.col(f"{r}.meas.uom").alias("result_unit"),
        F.col(f"{r}.acqTs").alias("acquired_text"), F.col(f"{r}.proto").alias("assay_protocol"),
        F.col(f"{r}.operator").alias("operator_id"), F.col(f"{r}.batchGuid").alias("batch_guid"),
        F.col(f"{r}.qcFlag").alias("qc_flag"),
    )


@query("s2_record_unmarshal", f"SELECT {READING_COLUMNS} FROM bronze")
def record_unmarshal(spark, d):
    return envelope.unmarshal(envelope.vendor_records(B.pages(spark, d)))


def _result_set_bodies(spark, d):
    """Orders as column-major result sets, 500 to a set, the last one shorter."""
    return resultset.write_result_sets(B.raw_observations(spark, d, "o_orderkey").withColumn(
        "effective_ts", F.date_format("effective_ts", "yyyy-MM-dd'T'HH:mm:ss")), ["o_orderkey"])


def _in_two_lots(bodies, path):
    """Land bodies as JSON files, one per line, in two lots; the second has the last, partly filled page."""
    bodies = pin(bodies)
    middle = bodies.agg(F.expr("max(page_offset) DIV 2")).scalar()
    for lot in (F.col("page_offset") < middle, F.col("page_offset") >= middle):
        bodies.where(lot).select("body").write.mode("append").text(path)
    return path


@query("s3_resultset_rows", """
    SELECT patient_ref, drug_code, observation_type, value,
      strftime(effective_ts, '%Y-%m-%dT%H:%M:%S') AS effective_ts FROM raw_obs""")
def resultset_rows(spark, d):
    sets = resultset.parse_result_sets(_result_set_bodies(spark, d))
    return resultset.result_rows(
        sets, ["patient_ref", "drug_code", "observation_type", "value", "effective_ts"])


@query("s4_cell_unwrap", """
    SELECT event_id, event_type AS first_cell, CAST(value AS VARCHAR) AS second_cell FROM events""")
def cell_unwrap(spark, d):
    kind, value = F.col("event_type"), F.col("value").cast("string")
    wrapped = F.to_json(F.struct(F.array(
        F.struct(kind.alias("string_value"), F.lit(None).cast("string").alias("number_value")),
        F.struct(F.lit(None).cast("string").alias("string_value"), value.alias("number_value")),
    ).alias("values")))
    plain = F.to_json(F.array(kind, value))
    raw = B.events(spark, d).select(
        "event_id", F.when(F.expr(B.CODE) < 50, wrapped).otherwise(plain).alias("body"))
    return resultset.unwrap_cells(raw).select(
        "event_id", F.col("cells")[0].alias("first_cell"), F.col("cells")[1].alias("second_cell"))


@query("s5_object_listing", """
    SELECT event_type AS name, count(*) AS record_count FROM events GROUP BY event_type""")
def object_listing(spark, d):
    per_type = B.events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("recordCount"))
    body = F.to_json(F.struct(F.struct(F.array(
        F.struct(F.col("event_type").alias("name"), "recordCount")).alias("objects")).alias("LIMS_EXPORT")))
    return envelope.list_objects(per_type.select(body.alias("body")))


@query("s6_paged_read", f"SELECT {READING_COLUMNS} FROM bronze")
def paged_read(spark, d):
    """Pages that were landed in two lots."""
    return envelope.ingest_readings(envelope.read_pages(spark, _in_two_lots(B.page_bodies(spark, d), scratch_path(spark, "pages"))))


@query("s6_paged_result_sets", "SELECT patient_ref, drug_code, observation_type, value, effective_ts FROM raw_obs")
def paged_result_sets(spark, d):
    """The clinical feed, landed in two lots."""
    path = _in_two_lots(_result_set_bodies(spark, d), scratch_path(spark, "sets"))
    return resultset.ingest_observations(resultset.read_result_sets(spark, path))


@query("s6_json_page_files", f"SELECT {READING_COLUMNS} FROM bronze")
def json_page_files(spark, d):
    path = scratch_path(spark, "page-files")
    B.page_bodies(spark, d).select("body").write.text(path)
    return envelope.ingest_readings(envelope.read_pages(spark, path))


# Lines that are no pages, one after every page but each fourth.
_BAD = """CASE page_offset DIV 200 % 4 WHEN 1 THEN concat('{"LIMS_EXPORT": {"resultSet": {"offset": ', page_offset)
      WHEN 2 THEN concat('{"error": "busy", "offset": ', page_offset, '}')
      WHEN 3 THEN concat('{"LIMS_EXPORT": {"object": "assay_results", "offset": ', page_offset, '}}') END"""

_REJECTS = """
    SELECT CASE i // 200 % 4 WHEN 1 THEN '{"LIMS_EXPORT": {"resultSet": {"offset": ' || i
        WHEN 2 THEN '{"error": "busy", "offset": ' || i || '}' ELSE '{"LIMS_EXPORT": {"object": "assay_results", "offset": ' || i || '}}' END AS body,
      CASE i // 200 % 4 WHEN 1 THEN 'unreadable_json' WHEN 2 THEN 'no_envelope' ELSE 'no_records' END AS reject_reason
    FROM range((SELECT count(*) FROM events)) t(i) WHERE i % 200 = 0 AND i // 200 % 4 <> 0"""


def _mixed_bodies(spark, d):
    """Pages, and lines among them that are none."""
    return B.page_bodies(spark, d).selectExpr("page_offset", f"explode(filter(array(body, {_BAD}), b -> b IS NOT NULL)) AS body")


@query("s1_page_rejects", _REJECTS)
def page_rejects(spark, d):
    """What no page could be read from, as it came."""
    return envelope.rejected_pages(_mixed_bodies(spark, d)).select("body", "reject_reason")


def _landed(spark, d):
    path = _in_two_lots(_mixed_bodies(spark, d), scratch_path(spark, "mixed"))
    return envelope.land_pages(spark, path, scratch_path(spark, "mixed-landed"))


@query("s6_landed_pages", f"SELECT {READING_COLUMNS} FROM bronze")
def landed_pages(spark, d):
    """Bad lines among the pages take nothing from the readings."""
    return envelope.ingest_readings(_landed(spark, d)[0])


@query("s6_landed_rejects", _REJECTS)
def landed_rejects(spark, d):
    return _landed(spark, d)[1].select("body", "reject_reason")


@query("s6_landed_counts", f"""
    SELECT 'good' AS outcome, count(*) AS n_lines FROM range((SELECT count(*) FROM events)) t(i) WHERE i % 200 = 0
    UNION ALL SELECT reject_reason, count(*) FROM ({_REJECTS}) GROUP BY 1""")
def landed_counts(spark, d):
    """Lines by outcome add up to those that were landed."""
    return lines.outcome_counts(lines.parse_lines(_mixed_bodies(spark, d), envelope.PAGE_LINE))


@query("s7_schema_coercion", """
    SELECT CAST(event_id AS VARCHAR) AS sample_id, CASE WHEN k >= 7 THEN 1 + k END AS replicate,
      CASE WHEN k <> 8 THEN value END AS result_value,
      CASE WHEN k <> 9 THEN ts END AS acquired_ts FROM ev""")
def schema_coercion(spark, d):
    k = F.expr(B.CODE)
    staged = B.events(spark, d).select(
        F.col("event_id").cast("string").alias("sample_id"),
        F.when(k < 7, "x").otherwise((1 + k).cast("string")).alias("replicate"),
        F.when(k == 8, "much").otherwise(F.col("value").cast("string")).alias("result_value"),
        F.when(k == 9, "2024-13-01 00:00:00").otherwise(F.col("ts").cast("string")).alias("acquired_ts"),
    )
    wanted = ("sample_id", "replicate", "result_value", "acquired_ts")
    return coerce.to_declared(staged, StructType([READING[n] for n in wanted]))


@query("s8_snapshot_table", f"""SELECT {READING_COLUMNS}, 'readings that passed the gate' AS table_comment, 'silver' AS quality,
    'events' AS fed_by FROM labelled WHERE quarantine_reason IS NULL""")
def snapshot_table(spark, d):
    """A table replaced twice, with its comment and properties as read back."""
    valid, _ = quality.split_quality(B.dirty_readings(spark, d))
    name = "sigreview_readings"
    tables.save_snapshot(valid.limit(0), name, path=scratch_path(spark, "silver"))
    table = tables.save_snapshot(valid, name, "readings that passed the gate", scratch_path(spark, "silver"), quality="silver", fed_by="events")
    notes = tables.table_notes(spark, name)
    return table.withColumns({"table_comment": F.lit(notes["comment"]), "quality": F.lit(notes["quality"]), "fed_by": F.lit(notes["fed_by"])})


@query("s8_versioned_publish", f"""SELECT {READING_COLUMNS}, 'readings that passed the gate' AS table_comment, 'silver' AS quality,
    2 AS n_versions FROM labelled WHERE quarantine_reason IS NULL""")
def versioned_publish(spark, d):
    """Published three times: with a column more, then from what is published itself, then as it should be."""
    dirty, name, folder = B.dirty_readings(spark, d), "sigreview_published", scratch_path(spark, "published")
    first = tables.publish_version(quality.label_quality(dirty), name, folder, "all readings")
    tables.publish_version(first.where("quarantine_reason IS NULL"), name, folder)
    valid = spark.table(name).drop("quarantine_reason")
    table = tables.publish_version(valid, name, folder, "readings that passed the gate", quality="silver")
    notes = tables.table_notes(spark, name)
    return table.withColumns({"table_comment": F.lit(notes["comment"]), "quality": F.lit(notes["quality"]),
                              "n_versions": F.lit(len(tables.versions(spark, folder)))})


@query("s9_reference_table", """
    SELECT t.assay_name, t.concern_direction, t.concern_threshold, t.unit, t.is_synthetic, h.n AS n_readings
    FROM thresholds t LEFT JOIN (SELECT assay_name, count(*) AS n FROM readings GROUP BY assay_name) h
      ON h.assay_name = t.assay_name""")
def reference_table(spark, d):
    n = B.readings(spark, d).groupBy("assay_name").agg(F.count(F.lit(1)).alias("n_readings"))
    return B.reference(spark).join(n, "assay_name", "left").drop("rationale")


@query("s10_view_publish", "SELECT * FROM summary")
def view_publish(spark, d):
    tables.publish_view(B.summary(spark, d), "signal_summary_view")
    return spark.sql("SELECT compound_id, correlation_state, n_adverse_obs, signal_summary FROM signal_summary_view")


@query("s11_page_writer", """
    SELECT i - i % 200 AS page_offset, max(n) AS total_count, count(*) AS returned, count(*) AS n_records,
      CASE WHEN i - i % 200 + count(*) < max(n) THEN i - i % 200 + count(*) END AS next_offset,
      arg_min(sample_id, i) AS first_sample, arg_max(sample_id, i) AS last_sample
    FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM composite)
    GROUP BY i - i % 200""")
def page_writer(spark, d):
    records = "page.LIMS_EXPORT.resultSet.records"
    pages = B.pages(spark, d).withColumns({
        "first_sample": F.element_at(records, 1)["smpl"],
        "last_sample": F.element_at(records, -1)["smpl"],
    })
    return envelope.page_index(pages, "first_sample", "last_sample")


@query("s12_json_rows", """
    SELECT '{"reading_id":"' || reading_id || '","assay_name":"' || assay_name || '","margin":'
      || coalesce(CAST(margin AS VARCHAR), 'null') || ',"evaluated_ts":"'
      || strftime(evaluated_ts, '%Y-%m-%dT%H:%M:%S') || '.000000"}' AS json FROM flags""")
def json_rows(spark, d):
    return tables.json_rows(B.flags(spark, d).select("reading_id", "assay_name", "margin", "evaluated_ts"))
