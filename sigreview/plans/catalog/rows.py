"""Projections, filters, windows, sorts and set operations."""

from pyspark.sql import functions as F

from ...operators import (
    actions, correlate, deidentify, kpi, lookups, quality, review_queue, rollup, scoring, spread,
)
from ...session import scratch_path
from .. import bindings as B
from .base import query

READING_COLUMNS = (
    "sample_id, compound_id, plate, well, replicate, assay_name, result_value, result_unit, "
    "acquired_ts, assay_protocol, operator_id, batch_guid, qc_flag"
)


@query("p1_projection", "SELECT drug_code, observation_type, value, effective_ts FROM raw_obs")
def projection(spark, d):
    return B.raw_observations(spark, d).select(*deidentify.KEPT)


@query("p2_quality_gate", f"SELECT {READING_COLUMNS} FROM labelled WHERE quarantine_reason IS NULL")
def quality_gate(spark, d):
    return quality.split_quality(B.dirty_readings(spark, d))[0]


@query("p3_quarantine", f"SELECT {READING_COLUMNS}, quarantine_reason FROM labelled WHERE quarantine_reason IS NOT NULL")
def quarantine(spark, d):
    return quality.split_quality(B.dirty_readings(spark, d))[1]


@query("p4_reconciliation", """
    SELECT count(*) AS source_rows, count(*) FILTER (WHERE quarantine_reason IS NULL) AS valid_rows,
      count(quarantine_reason) AS quarantined_rows, TRUE AS reconciled FROM labelled""")
def reconciliation(spark, d):
    return quality.reconcile(B.dirty_readings(spark, d))


@query("p4_reconciled_write", """
    SELECT count(*) AS source_rows, count(*) FILTER (WHERE quarantine_reason IS NULL) AS valid_rows,
      count(quarantine_reason) AS quarantined_rows, TRUE AS reconciled,
      count(*) FILTER (WHERE quarantine_reason IS NULL) AS written_valid, count(quarantine_reason) AS written_quarantine FROM labelled""")
def reconciled_write(spark, d):
    """The counts that the gate's own write took, beside those of what it wrote."""
    valid, bad, counts = quality.write_split(B.dirty_readings(spark, d), scratch_path(spark, "gate"))
    return counts.withColumns({"written_valid": F.lit(valid.count()), "written_quarantine": F.lit(bad.count())})


@query("p5_null_drop", """
    SELECT count(*) AS source_rows, count(*) FILTER (WHERE drug_code IS NULL OR observation_type IS NULL
      OR effective_ts IS NULL) AS dropped_rows FROM raw_obs""")
def null_drop(spark, d):
    return deidentify.dropped_rows(B.raw_observations(spark, d))


@query("p6_status_filter", "SELECT reading_id, compound_id, margin FROM prior_queue WHERE status = 'open'")
def status_filter(spark, d):
    return review_queue.open_rows(B.prior_queue(spark, d)).select("reading_id", "compound_id", "margin")


@query("p7_trailing_days", """
    SELECT sample_id, acquired_ts FROM readings
    WHERE acquired_ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""")
def trailing_days(spark, d):
    return kpi.trailing_days(B.readings(spark, d), "acquired_ts", 7, B.AS_OF).select(
        "sample_id", "acquired_ts")


@query("p8_id_search", "SELECT compound_id, n_readings FROM (SELECT compound_id, count(*) AS n_readings FROM readings GROUP BY 1) WHERE contains(lower(compound_id), lower('mpD0001'))")
def id_search(spark, d):
    return review_queue.find_compounds(B.compound_registry(spark, d), "mpD0001").select("compound_id", "n_readings")


@query("p9_optional_filter_limit", """
    SELECT * FROM (SELECT 'all' AS listing, reading_id, status FROM prior_queue
    UNION ALL SELECT 'cleared', reading_id, status FROM prior_queue WHERE status = 'cleared'
    UNION ALL (SELECT 'open top', reading_id, status FROM prior_queue WHERE status = 'open'
      ORDER BY margin ASC NULLS LAST, compound_id, reading_id LIMIT 25))""")
def optional_filter_limit(spark, d):
    q = B.prior_queue(spark, d)
    parts = [("all", None, None), ("cleared", "cleared", 0), ("open top", "open", 25)]
    listed = [
        review_queue.queue_view(q, status, limit).select(F.lit(name).alias("listing"), "reading_id", "status")
        for name, status, limit in parts
    ]
    return listed[0].unionByName(listed[1]).unionByName(listed[2])


@query("p10_point_lookup", """
    SELECT assay_name, result_value, result_unit, strftime(acquired_ts, '%Y-%m-%d %H:%M:%S.%f') AS acquired_ts, qc_flag
    FROM readings WHERE compound_id = 'CMPD00012' AND assay_name = 'error'""")
def point_lookup(spark, d):
    return lookups.pair_history(spark, B.readings(spark, d), "CMPD00012", "error")


@query("p11_reason_validation", """
    SELECT reading_id, seq, action, resolution_reason, coalesce(action = 'reopen' OR resolution_reason IN
      ('false_positive', 'confirmed_concern', 'escalated_for_confirmatory_assay'), FALSE) AS accepted FROM action_log""")
def reason_validation(spark, d):
    accepted, rejected = actions.split_actions(B.action_log(B.prior_queue(spark, d)))
    columns = ("reading_id", "seq", "action", "resolution_reason")
    return accepted.select(*columns, F.lit(True).alias("accepted")).unionByName(
        rejected.select(*columns, F.lit(False).alias("accepted")))


# --- windows ---------------------------------------------------------------

@query("w1_top_with_ties", """
    SELECT assay_name, n_flagged FROM (SELECT assay_name, count(*) AS n_flagged, rank() OVER (ORDER BY count(*) DESC) AS r
      FROM flags WHERE is_flagged GROUP BY assay_name) WHERE r = 1""")
def top_with_ties(spark, d):
    return kpi.top_with_ties(scoring.flagged_per_assay(B.flags(spark, d)), "n_flagged")


@query("w2_latest_readings", """
    SELECT compound_id, sample_id, assay_name, result_value, result_unit, acquired_ts, recency FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY compound_id ORDER BY acquired_ts DESC, sample_id) AS INT) AS recency
      FROM readings) WHERE recency <= 3""")
def latest_readings(spark, d):
    return lookups.latest_readings(B.readings(spark, d), 3)


@query("w3_share_of_worst", """
    SELECT compound_id, worst_breach, round(worst_breach * 100 / greatest(1.0, max(worst_breach) OVER ()), 6) AS percent_of_worst
    FROM totals""")
def share_of_worst(spark, d):
    shares = rollup.share_of_worst(rollup.compound_totals(B.queue(spark, d)))
    return shares.select("compound_id", "worst_breach", F.round("percent_of_worst", 6).alias("percent_of_worst"))


@query("w4_action_fold", "SELECT reading_id, status, resolved_by, resolution_reason FROM acted")
def action_fold(spark, d):
    return B.acted(spark, d)[0].select("reading_id", "status", "resolved_by", "resolution_reason")


# --- sorts -------------------------------------------------------------------

@query("o1_queue_order", """
    SELECT reading_id, margin, row_number() OVER (ORDER BY margin ASC NULLS LAST, compound_id, reading_id) AS position
    FROM merged WHERE status = 'open'""")
def queue_order(spark, d):
    return review_queue.queue_positions(B.queue(spark, d)).select("reading_id", "margin", "position")


@query("o2_risk_order", """
    SELECT compound_id, clinical_rank, open_flags, worst_breach, row_number() OVER (
      ORDER BY clinical_rank DESC, open_flags DESC, worst_breach DESC, compound_id) AS position FROM totals""")
def risk_order(spark, d):
    return rollup.risk_positions(B.queue(spark, d)).select(
        "compound_id", "clinical_rank", "open_flags", "worst_breach", "position")


@query("o3_worst_margins", """
    SELECT * FROM (SELECT compound_id, reading_id, assay_name, margin FROM flags WHERE is_flagged
    ORDER BY margin ASC NULLS LAST, compound_id, reading_id LIMIT 5)""")
def worst_margins(spark, d):
    return lookups.worst_margins(B.flags(spark, d), 5).select("compound_id", "reading_id", "assay_name", "margin")


@query("o4_history_order", """
    SELECT compound_id, assay_name, sample_id, acquired_ts, result_value, row_number() OVER (
      PARTITION BY compound_id, assay_name ORDER BY acquired_ts, sample_id) AS position FROM readings""")
def history_order(spark, d):
    return lookups.history_positions(B.readings(spark, d))


@query("o5_nested_order", "SELECT compound_id, part, open_flags, reading_ids FROM small_nested")
def nested_order(spark, d):
    """The order of the nested array itself, two readings to a part."""
    nested = rollup.rollup_readings(B.queue(spark, d), per_part=2)
    return nested.withColumn("reading_ids", F.array_join("readings.reading_id", ",")).drop("readings")


@query("o6_source_order", """
    SELECT sample_id, assay_name, row_number() OVER (ORDER BY sample_id, assay_name) AS position FROM readings""")
def source_order(spark, d):
    slim = B.readings(spark, d).select("sample_id", "assay_name")
    return spread.number_rows(slim, ["sample_id", "assay_name"])


# --- set operations ------------------------------------------------------------

@query("x1_labelled_union", """
    SELECT 'readings' AS part, count(*) AS n FROM dirty
    UNION ALL SELECT 'valid', count(*) FILTER (WHERE quarantine_reason IS NULL) FROM labelled
    UNION ALL SELECT 'quarantine', count(quarantine_reason) FROM labelled
    UNION ALL SELECT 'observations', count(*) FROM obs
    UNION ALL SELECT 'registry', count(DISTINCT compound_id) FROM readings""")
def labelled_union(spark, d):
    dirty = B.dirty_readings(spark, d)
    valid, bad = quality.split_quality(dirty)
    parts = {
        "readings": dirty, "valid": valid, "quarantine": bad,
        "observations": B.observations(spark, d), "registry": B.compound_registry(spark, d),
    }
    out = None
    for name, df in parts.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("x2_no_longer_flagged", """
    SELECT reading_id FROM earlier_flags WHERE is_flagged
      AND reading_id NOT IN (SELECT reading_id FROM flags WHERE is_flagged)""")
def no_longer_flagged(spark, d):
    before = B.flags(spark, d, B.EARLIER, B.EARLIER_STAMP).where("is_flagged").select("reading_id")
    now = B.flags(spark, d).where("is_flagged").select("reading_id")
    return before.join(now, "reading_id", "left_anti")


@query("a6_distinct_keys", """
    SELECT 'drug' AS kind, drug_code AS id FROM (SELECT DISTINCT drug_code FROM obs)
    UNION ALL SELECT 'compound', compound_id FROM (SELECT DISTINCT compound_id FROM flags WHERE is_flagged)""")
def distinct_keys(spark, d):
    drugs = correlate.known_drugs(B.observations(spark, d)).select(F.lit("drug").alias("kind"), F.col("drug_code").alias("id"))
    compounds = correlate.flagged_compounds(B.flags(spark, d)).select(
        F.lit("compound").alias("kind"), F.col("compound_id").alias("id"))
    return drugs.unionByName(compounds)
