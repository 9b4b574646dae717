"""Scalar functions, each over a whole table."""

from pyspark.sql import functions as F

from ... import fixed_values as V
from ...functions import decide, parse, privacy, text
from ...operators import correlate, drift, kpi, review_queue
from .. import bindings as B
from .base import query

_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


@query("f1_composite_id", """
    SELECT sample_id, CASE WHEN k <> 6 THEN compound_id END AS compound_id, CASE WHEN k <> 6 THEN plate END AS plate,
      CASE WHEN k <> 6 THEN well END AS well, CASE WHEN k <> 6 THEN replicate END AS replicate FROM composite""")
def composite_id(spark, d):
    sample = "sample_id"
    return B.composite_readings(spark, d).selectExpr(
        sample, f"{parse.sample_compound(sample)} AS compound_id", f"{parse.sample_plate(sample)} AS plate",
        f"{parse.sample_well(sample)} AS well", f"{parse.sample_replicate(sample)} AS replicate")


@query("f2_vendor_timestamp", """
    SELECT event_id, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN NULL ELSE date_trunc('milliseconds', ts) END AS parsed FROM ev""")
def vendor_timestamp(spark, d):
    raw = (
        f"CASE WHEN {B.CODE} = 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS') "
        f"WHEN {B.CODE} = 1 THEN concat(date_format(ts, 'yyyy'), '0230 00:00:00.000') "
        f"WHEN {B.CODE} < 50 THEN date_format(ts, 'yyyyMMdd HH:mm:ss.SSSSSS') "
        f"ELSE {parse.vendor_timestamp_text('ts')} END AS raw"
    )
    return B.events(spark, d).selectExpr("event_id", raw).selectExpr(
        "event_id", f"{parse.vendor_timestamp('raw')} AS parsed")


@query("f3_lenient_number", "SELECT event_id, CASE WHEN k >= 4 THEN value END AS parsed FROM ev")
def lenient_number(spark, d):
    raw = (
        f"CASE WHEN {B.CODE} = 0 THEN 'n/a' WHEN {B.CODE} = 1 THEN concat(value, 'f') WHEN {B.CODE} = 2 THEN '' "
        f"WHEN {B.CODE} = 3 THEN NULL WHEN {B.CODE} < 50 THEN concat(' ', value, ' ') "
        "ELSE CAST(value AS STRING) END AS raw"
    )
    return B.events(spark, d).selectExpr("event_id", raw).selectExpr(
        "event_id", f"{parse.lenient_number('raw')} AS parsed")


@query("f4_nested_field", "SELECT event_id, CASE WHEN k >= 50 THEN k END AS k, CASE WHEN k >= 50 THEN 'uM' END AS unit FROM ev")
def nested_field(spark, d):
    """A nested record with fields that are absent, or absent as a whole."""
    k = F.expr(B.CODE)
    body = F.when(k < 25, "{}").when(k < 50, '{"meas": null}').otherwise(
        F.concat(F.lit('{"meas": {"val": '), k.cast("string"), F.lit(', "uom": "uM"}}')))
    parsed = F.from_json(body, "meas struct<val:int, uom:string>")
    return B.events(spark, d).select(
        "event_id", parsed["meas"]["val"].alias("k"), parsed["meas"]["uom"].alias("unit"))


@query("f5_iso_timestamp", "SELECT event_id, CASE WHEN k > 0 THEN date_trunc('second', ts) END AS parsed FROM ev")
def iso_timestamp(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.expr(B.CODE) == 0, F.concat(iso, F.lit("#"))).otherwise(iso)
    return B.events(spark, d).select("event_id", raw.alias("raw")).selectExpr(
        "event_id", f"{parse.iso_timestamp('raw')} AS parsed")


@query("f6_structure_placeholder", """
    SELECT DISTINCT compound_id, 'SYNTH-INCHIKEY-' || upper(substr(md5(compound_id), 1, 20)) AS placeholder FROM readings""")
def structure_placeholder(spark, d):
    return B.readings(spark, d).selectExpr(
        "compound_id", f"{privacy.structure_placeholder('compound_id')} AS placeholder").distinct()


@query("f7_f8_pseudonyms", """
    SELECT patient_ref, sha256(patient_ref || ':sigreview-test-salt') AS first_key,
      'anon-' || substr(sha256(sha256(patient_ref || ':sigreview-test-salt')), 1, 10) AS second_key FROM raw_obs""")
def pseudonyms(spark, d):
    key = privacy.pseudonym("patient_ref", B.SALT)
    return B.raw_observations(spark, d).selectExpr(
        "patient_ref", f"{key} AS first_key", f"{privacy.second_pseudonym(key)} AS second_key")


@query("f9_f10_f11_verdict", "SELECT reading_id, is_flagged, margin, reason FROM flags")
def verdict(spark, d):
    return B.flags(spark, d).select("reading_id", "is_flagged", "margin", "reason")


@query("f12_f13_f14_signal", """
    SELECT c.compound_id, c.correlation_state, c.signal_detail, s.signal_summary,
      CASE c.correlation_state WHEN 'correlated' THEN 2 WHEN 'checked_no_correlation' THEN 1 ELSE 0 END AS state_rank
    FROM correlation c JOIN summary s USING (compound_id)""")
def signal(spark, d):
    state = "correlation_state"
    return B.correlation(spark, d).selectExpr(
        "compound_id", state, "signal_detail",
        f"{decide.signal_summary(state)} AS signal_summary", f"{decide.state_rank(state)} AS state_rank")


@query("f15_defaults", """
    SELECT r.sample_id, coalesce(h.prior_n, 0) AS prior_n, coalesce(t.is_synthetic, FALSE) AS is_synthetic,
      coalesce(c.correlation_state, 'no_mapping') AS state
    FROM readings r LEFT JOIN thresholds t ON t.assay_name = r.assay_name
    LEFT JOIN hist h ON h.compound_id = r.compound_id AND h.assay_name = r.assay_name
    LEFT JOIN correlation c ON c.compound_id = r.compound_id""")
def defaults(spark, d):
    f = review_queue.with_signal(B.flags(spark, d), B.correlation(spark, d))
    return f.select(
        F.col("reading_id").alias("sample_id"), F.col("compound_prior_n").alias("prior_n"),
        F.col("is_synthetic_reference").alias("is_synthetic"),
        F.coalesce("clinical_correlation_state", F.lit(V.NO_MAPPING)).alias("state"))


@query("f16_struct", "SELECT reading_id, is_flagged, margin FROM flags")
def struct_fields(spark, d):
    v = F.struct("is_flagged", F.col("margin").alias("margin"))
    return B.flags(spark, d).select("reading_id", v.alias("v")).select("reading_id", "v.is_flagged", "v.margin")


@query("f17_text_join", """
    SELECT drug_code, count(*) AS n_adverse, string_agg(DISTINCT value, ', ' ORDER BY value) AS terms,
      concat_ws('/', drug_code, NULL, 'adverse') AS label
    FROM obs WHERE observation_type = 'adverse_reaction' GROUP BY drug_code""")
def text_join(spark, d):
    return correlate.adverse_by_drug(B.observations(spark, d)).select(
        "drug_code", "n_adverse", F.array_join(F.array_sort("terms"), ", ").alias("terms"),
        F.concat_ws("/", "drug_code", F.lit(None).cast("string"), F.lit("adverse")).alias("label"))


@query("f18_abs_round", """
    SELECT reading_id, abs(margin) AS breach, CAST(round(margin, 3) AS VARCHAR) AS margin_text FROM flags""")
def abs_round(spark, d):
    return B.flags(spark, d).select(
        "reading_id", F.abs("margin").alias("breach"), F.round("margin", 3).cast("string").alias("margin_text"))


@query("f19_elapsed", """
    SELECT event_id, round(epoch(TIMESTAMP '2024-01-31 00:00:00' - ts), 6) AS seconds,
      CAST(round(CAST(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) AS DECIMAL(24, 6)) / 3600000000, 2) AS DOUBLE) AS hours
    FROM events""")
def elapsed(spark, d):
    seconds = kpi.elapsed_seconds("ts", text.stamp(B.AS_OF))
    return B.events(spark, d).selectExpr(
        "event_id", f"round({seconds}, 6) AS seconds", f"{kpi.hours(seconds)} AS hours")


@query("f20_f21_task_text", """
    SELECT assay_name, CAST(CAST(round_even(observed_fpr * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS rate_text,
      'tr-' || assay_name || '-2024-01-31' AS task_id,
      'Review ' || assay_name || ' deterministic threshold: ' || CAST(n_false_positive AS VARCHAR) || '/'
        || CAST(n_resolved AS VARCHAR) || ' recent flags were resolved as false positives (FPR '
        || CAST(CAST(round_even(observed_fpr * 100, 0) AS BIGINT) AS VARCHAR) || '% > 34%).' AS action_text FROM drift""")
def task_text(spark, d):
    rates = drift.drift_rates(B.resolved_items(spark, d), B.TOLERANCE)
    action = text.task_action("assay_name", "n_false_positive", "n_resolved", "observed_fpr", B.TOLERANCE)
    return rates.selectExpr(
        "assay_name", f"{text.percent('observed_fpr')} AS rate_text",
        f"{text.task_id('assay_name', B.AS_OF)} AS task_id", f"{action} AS action_text")


@query("f22_stamp", f"SELECT reading_id, {_AS_OF} AS evaluated_ts FROM flags")
def stamp(spark, d):
    return B.flags(spark, d).select("reading_id", "evaluated_ts")


@query("f24_reply_parse", """
    SELECT event_id, CASE WHEN k >= 20 THEN CASE event_id % 4 WHEN 0 THEN 'deprioritize'
        WHEN 1 THEN 'escalate for confirmatory assay' WHEN 2 THEN 'monitor next cycle' ELSE 'proceed' END END AS action,
      CASE WHEN k >= 10 THEN 'value ' || CAST(value AS VARCHAR) END AS rationale, k >= 20 AS is_valid FROM ev""")
def reply_parse(spark, d):
    """Replies built from the events: some of one line, some with an unknown action."""
    choices = ", ".join(text.quote(a) for a in V.ADVISORY_ACTIONS)
    action = f"CASE WHEN {B.CODE} < 20 THEN 'call the lab' ELSE array({choices})[CAST(event_id % 4 AS INT)] END"
    reply = (
        f"CASE WHEN {B.CODE} < 10 THEN concat('{V.REPLY_ACTION}', {action}) ELSE "
        f"concat('{V.REPLY_ACTION}', {action}, '\\n', '{V.REPLY_RATIONALE}', 'value ', value) END AS reply"
    )
    return B.events(spark, d).selectExpr("event_id", reply).selectExpr(
        "event_id", f"{text.reply_action('reply')} AS action", f"{text.reply_rationale('reply')} AS rationale",
        f"{text.reply_valid('reply')} AS is_valid")


@query("f25_group_id", """
    SELECT coalesce(CASE WHEN k <> 6 THEN compound_id END, 'none') AS group_id, count(*) AS n FROM composite GROUP BY 1""")
def group_id(spark, d):
    group = f"coalesce({parse.sample_group('sample_id')}, 'none') AS group_id"
    return B.composite_readings(spark, d).selectExpr(group).groupBy("group_id").agg(F.expr("count(1) AS n"))


@query("u3_masks", """
    SELECT m.member AS is_member, CASE WHEN m.member THEN o.value ELSE 'REDACTED — clinical detail (clinical_pis only)' END AS value,
      CASE WHEN m.member THEN o.patient_pseudonym ELSE 'anon-' || substr(sha256(o.patient_pseudonym), 1, 10) END AS patient_key,
      (m.member OR o.observation_type <> 'lab_result') AS visible
    FROM obs o JOIN (VALUES (TRUE), (FALSE)) m(member) ON TRUE""")
def masks(spark, d):
    member = "is_member"
    both = B.observations(spark, d).selectExpr("*", "explode(array(TRUE, FALSE)) AS is_member")
    return both.selectExpr(
        member, f"{privacy.mask_value('value', member)} AS value",
        f"{privacy.mask_key('patient_pseudonym', member)} AS patient_key",
        f"{privacy.row_visible('observation_type', member)} AS visible")
