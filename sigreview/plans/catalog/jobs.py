"""Composite jobs: what a user calls."""

import pandas as pd
from pyspark.sql import functions as F

from ... import fixed_values as V
from ...functions import text
from ...operators import advice, correlate, deidentify, drift, lookups, quality, registry
from ...operators import review_queue, rollup
from ...schemas import READING
from ...session import pin, scratch_path
from ...sources import envelope, resultset
from .. import bindings as B
from .. import question_functions, questions
from . import aggregates, joins
from .base import query
from .sources import _result_set_bodies

_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
READING_COLUMNS = ", ".join(READING.fieldNames())


@query("c1_ingest_readings", f"SELECT {READING_COLUMNS} FROM bronze")
def ingest_readings(spark, d):
    return envelope.ingest_readings(B.pages(spark, d))


@query("c2_ingest_observations", "SELECT patient_ref, drug_code, observation_type, value, effective_ts FROM raw_obs")
def ingest_observations(spark, d):
    return resultset.ingest_observations(resultset.parse_result_sets(_result_set_bodies(spark, d)))


@query("c3_split_quality", f"SELECT {READING_COLUMNS}, coalesce(quarantine_reason, 'valid') AS outcome FROM labelled")
def split_quality(spark, d):
    valid, bad = quality.split_quality(B.dirty_readings(spark, d))
    return valid.withColumn("outcome", F.lit("valid")).unionByName(
        bad.withColumnRenamed("quarantine_reason", "outcome"))


@query("c4_compound_registry", """
    SELECT compound_id, 'SYNTH-INCHIKEY-' || upper(substr(md5(compound_id), 1, 20)) AS structure_id_placeholder,
      TRUE AS structure_is_synthetic_placeholder, count(*) AS n_readings, count(DISTINCT assay_name) AS n_assays,
      min(acquired_ts) AS first_seen, max(acquired_ts) AS last_seen FROM readings GROUP BY compound_id""")
def compound_registry(spark, d):
    return B.compound_registry(spark, d)


@query("c4_patient_registry", """
    SELECT patient_pseudonym, count(*) AS n_observations, count(DISTINCT drug_code) AS n_drug_codes,
      min(effective_ts) AS first_seen, max(effective_ts) AS last_seen FROM obs GROUP BY patient_pseudonym""")
def patient_registry(spark, d):
    return registry.patient_registry(B.observations(spark, d))


@query("c5_score_readings", "SELECT * FROM flags")
def score_readings(spark, d):
    return B.flags(spark, d)


@query("c6_deidentify", "SELECT * FROM obs")
def deidentified(spark, d):
    return B.observations(spark, d)


query("c7_validate_crosswalk", joins._CROSSWALK)(joins.existence_join)


@query("c8_correlate", "SELECT * FROM correlation")
def correlated(spark, d):
    return B.correlation(spark, d)


@query("c9_public_summary", "SELECT * FROM summary")
def public_summary(spark, d):
    return B.summary(spark, d)


@query("c10_govern_outsider", """
    SELECT 'anon-' || substr(sha256(patient_pseudonym), 1, 10) AS patient_pseudonym, drug_code, observation_type,
      'REDACTED — clinical detail (clinical_pis only)' AS value, effective_ts FROM obs WHERE observation_type <> 'lab_result'""")
def govern_outsider(spark, d):
    return deidentify.govern(B.observations(spark, d), groups=["chemists"])


@query("c10_govern_member", "SELECT * FROM obs")
def govern_member(spark, d):
    return deidentify.govern(B.observations(spark, d), groups=[V.CLINICAL_GROUP])


_PROMPT = """
    SELECT b.compound_id, b.part, b.n_flags, coalesce(c.correlation_state, 'no_mapping') AS correlation_state, c.n_adverse_obs,
      'Advise a compound reviewer. The flags below were decided by a fixed rule; do not dispute them and add no facts. '
      || b.compound_id || ' has ' || CAST(b.n_flags AS VARCHAR) || ' flagged reading(s). Rule output: ' || b.reason_text
      || '. Breaches: ' || b.breaches || '. Clinical state: ' || coalesce(c.correlation_state, 'no_mapping')
      || CASE WHEN c.n_adverse_obs IS NOT NULL THEN ' with ' || CAST(c.n_adverse_obs AS VARCHAR)
           || ' adverse observation(s): ' || coalesce(c.signal_detail, '') ELSE '' END
      || '. Answer in two lines. First line ''ACTION: '' and one of [deprioritize, escalate for confirmatory assay, '
      || 'monitor next cycle, proceed]. Second line ''RATIONALE: '' and one sentence based on these facts.' AS recommendation_input,
      'stub-model' AS model_endpoint, TIMESTAMP '2024-01-31 00:00:00' AS generated_ts
    FROM {parts} b LEFT JOIN correlation c ON c.compound_id = b.compound_id"""


def _prompts(spark, d, per_part=advice.FLAGS_PER_PROMPT):
    flags = B.written_flags(spark, d)
    return advice.recommendation_prompts(flags, B.correlation(spark, d, flags), B.AS_OF, B.MODEL, per_part)


@query("c11_recommendation_prompts", _PROMPT.format(parts="breach_parts"))
def recommendation_prompts(spark, d):
    return _prompts(spark, d)


@query("f23_prompt", _PROMPT.format(parts="small_breach_parts"))
def small_prompts(spark, d):
    """The prompts two flags to a part."""
    return _prompts(spark, d, 2)


def stub_model(prompts: pd.Series) -> pd.Series:
    """A fixed rule in place of a hosted model: escalate where a signal is stated."""
    act = prompts.str.contains("Clinical state: correlated", regex=False)
    choice = act.map({True: V.ADVISORY_ACTIONS[1], False: V.ADVISORY_ACTIONS[2]})
    return "ACTION: " + choice + "\nRATIONALE: follows the stated clinical state."


@query("c12_recommend", """
    SELECT compound_id, CASE correlation_state WHEN 'correlated' THEN 'escalate for confirmatory assay'
      ELSE 'monitor next cycle' END AS action, 'follows the stated clinical state.' AS rationale, TRUE AS is_valid,
      n_parts FROM correlation JOIN (SELECT compound_id, count(*) AS n_parts FROM small_breach_parts GROUP BY 1) USING (compound_id)""")
def recommend(spark, d):
    """One action per compound, also where its prompt has several parts."""
    return advice.one_action(advice.checked_replies(advice.recommend(_prompts(spark, d, 2), stub_model)))


@query("c12_kept_replies", """
    SELECT compound_id, CASE correlation_state WHEN 'correlated' THEN 'escalate for confirmatory assay'
      ELSE 'monitor next cycle' END AS action, n_parts, n_prompts, 0 AS n_asked_again
    FROM correlation JOIN (SELECT compound_id, count(*) AS n_parts FROM small_breach_parts GROUP BY 1) USING (compound_id),
      (SELECT count(*) AS n_prompts FROM small_breach_parts)""")
def kept_replies(spark, d):
    """Two runs over the same prompts: each is asked once, and the second run asks none."""
    prompts, folder, asked = pin(_prompts(spark, d, 2)), scratch_path(spark, "replies"), spark.sparkContext.accumulator(0)

    def counted(texts: pd.Series) -> pd.Series:
        asked.add(len(texts))
        return stub_model(texts)
    pin(advice.recommend_kept(prompts, counted, folder))
    first = asked.value
    replies = pin(advice.recommend_kept(prompts, counted, folder))
    return advice.one_action(advice.checked_replies(replies)).select("compound_id", "action", "n_parts").withColumns(
        {"n_prompts": F.lit(first).cast("bigint"), "n_asked_again": F.lit(asked.value - first)})


def _synced(spark, d):
    past = B.written_history(spark, d)
    flags = B.written_flags(spark, d, past)
    return review_queue.sync_queue(
        B.prior_queue(spark, d, past), flags, B.correlation(spark, d, flags), B.AS_OF)


@query("c13_sync_queue", "SELECT * EXCLUDE (change) FROM merged")
def sync_queue(spark, d):
    return _synced(spark, d)[0]


@query("c13_sync_summary", """
    SELECT count(*) FILTER (WHERE change IN ('inserted', 'refreshed')) AS source_open_flags,
      count(*) FILTER (WHERE change IN ('inserted', 'refreshed')) AS upserted,
      count(*) FILTER (WHERE change = 'cleared') AS cleared_stale, count(*) FILTER (WHERE status = 'open') AS n_open,
      count(*) FILTER (WHERE status = 'resolved') AS n_resolved, count(*) FILTER (WHERE status = 'cleared') AS n_cleared FROM merged""")
def sync_summary(spark, d):
    return _synced(spark, d)[1]


@query("c13_clear_stale", f"""
    SELECT * REPLACE (CASE WHEN status = 'open' AND reading_id NOT IN (SELECT reading_id FROM queue_source) THEN 'cleared'
        ELSE status END AS status,
      CASE WHEN status = 'open' AND reading_id NOT IN (SELECT reading_id FROM queue_source) THEN {_AS_OF} ELSE synced_ts END AS synced_ts)
    FROM prior_queue""")
def clear_stale(spark, d):
    return review_queue.clear_stale(B.prior_queue(spark, d), B.queue_source(spark, d), B.AS_OF)


@query("c13_sync_options", f"""
    SELECT m.reading_id, CASE WHEN m.change = 'refreshed' AND m.status = 'cleared' THEN 'open' WHEN m.change = 'cleared' THEN 'open'
        ELSE m.status END AS status, coalesce(p.flagged_ts, m.flagged_ts) AS flagged_ts
    FROM merged m LEFT JOIN prior_queue p ON p.reading_id = m.reading_id""")
def sync_options(spark, d):
    """The sync with its options turned: reopen cleared, keep the first flag time, clear nothing."""
    return B.merged_queue(
        spark, d, clear_missing=False, reopen_cleared=True, keep_first_flagged=True
    ).select("reading_id", "status", "flagged_ts")


@query("c14_apply_actions", "SELECT * FROM acted")
def apply_actions(spark, d):
    return B.acted(spark, d)[0]


@query("c15_queue_rollup", """
    SELECT t.* EXCLUDE (row_number), part, reading_ids, row_number AS position FROM (SELECT *, row_number() OVER (
      ORDER BY clinical_rank DESC, open_flags DESC, worst_breach DESC, compound_id) AS row_number FROM totals) t
    JOIN (SELECT compound_id, part, reading_ids FROM nested) USING (compound_id)""")
def queue_rollup(spark, d):
    """The nested readings as the list of their ids, in the order of the array."""
    return rollup.queue_rollup(pin(B.queue(spark, d))).withColumn("reading_ids", F.array_join("readings.reading_id", ",")).drop("readings")


query("c16_convergence", aggregates.CONVERGENCE)(aggregates.convergence)
query("c16_triage_kpis", aggregates.TRIAGE)(aggregates.triage_kpis)
query("c16_flags_by_assay", aggregates.BY_ASSAY)(aggregates.flags_by_assay)

_TASKS = f"""
    SELECT 'tr-' || assay_name || '-2024-01-31' AS task_id, assay_name, round(observed_fpr, 6) AS observed_fpr, n_resolved,
      n_false_positive, CAST(0.335 AS DOUBLE) AS tolerance, 'open' AS status,
      'Review ' || assay_name || ' deterministic threshold: ' || CAST(n_false_positive AS VARCHAR) || '/'
        || CAST(n_resolved AS VARCHAR) || ' recent flags were resolved as false positives (FPR '
        || CAST(CAST(round_even(observed_fpr * 100, 0) AS BIGINT) AS VARCHAR) || '% > 34%).' AS suggested_action,
      {_AS_OF} AS opened_ts FROM drift WHERE label = 'drift'"""


@query("c17_drift_tasks", _TASKS)
def drift_tasks(spark, d):
    """The second run of a day refreshes the tasks of the first."""
    items = B.resolved_items(spark, d)
    first = drift.drift_tasks(drift.drift_rates(items, B.TOLERANCE), B.TOLERANCE, B.AS_OF).withColumns(
        {"status": F.lit("done"), "opened_ts": F.expr(text.stamp(B.EARLIER_STAMP))})
    _, tasks = drift.drift_check(items, first, B.AS_OF, B.TOLERANCE)
    return tasks.withColumn("observed_fpr", F.round("observed_fpr", 6))


# --- named questions -----------------------------------------------------------

@query("c18_q1_currently_flagged", """
    SELECT compound_id, assay_name, result_value, threshold, margin, reason FROM flags WHERE is_flagged""")
def q1(spark, d):
    return questions.currently_flagged(B.flags(spark, d))


@query("c18_q2_last_readings", """
    SELECT * FROM (SELECT compound_id, sample_id, assay_name, result_value, result_unit, acquired_ts,
      CAST(row_number() OVER (ORDER BY acquired_ts DESC, sample_id) AS INT) AS recency FROM readings
      WHERE compound_id = 'CMPD00012') WHERE recency <= 3""")
def q2(spark, d):
    return questions.last_readings(B.readings(spark, d), "CMPD00012")


@query("c18_q3_against_threshold", """
    SELECT r.compound_id, r.sample_id, r.assay_name, r.result_value, t.concern_threshold, t.concern_direction
    FROM readings r JOIN thresholds t ON t.assay_name = r.assay_name""")
def q3(spark, d):
    return questions.against_threshold(B.readings(spark, d), B.reference(spark))


@query("c18_q4_most_flagged_assay", """
    SELECT assay_name, n_flagged FROM (SELECT assay_name, count(*) AS n_flagged, rank() OVER (ORDER BY count(*) DESC) AS r
      FROM flags WHERE is_flagged GROUP BY assay_name) WHERE r = 1""")
def q4(spark, d):
    return questions.most_flagged_assay(B.flags(spark, d))


@query("c18_q5_registry_size", "SELECT count(DISTINCT compound_id) AS n_compounds FROM readings")
def q5(spark, d):
    return questions.registry_size(B.compound_registry(spark, d))


@query("c18_q6_concern_thresholds", """
    SELECT assay_name, concern_direction, concern_threshold, unit FROM thresholds
    WHERE assay_name IN (SELECT assay_name FROM readings)""")
def q6(spark, d):
    measured = B.readings(spark, d).select("assay_name").distinct()
    return questions.concern_thresholds(B.reference(spark)).join(measured, "assay_name", "left_semi")


@query("c18_q7_flagged_in_assay", """
    SELECT compound_id, reading_id, result_value, margin FROM flags
    WHERE is_flagged AND assay_name = 'error' AND result_value < 1.0""")
def q7(spark, d):
    return questions.flagged_in_assay(B.flags(spark, d), "error", below=1.0)


@query("c18_q8_average_per_compound", """
    SELECT compound_id, round(avg(result_value), 6) AS mean_value, count(*) AS n FROM readings
    WHERE assay_name = 'purchase' GROUP BY compound_id""")
def q8(spark, d):
    return questions.average_per_compound(B.readings(spark, d), "purchase").withColumn(
        "mean_value", F.round("mean_value", 6))


@query("c18_c1_correlated_compounds", "SELECT compound_id, signal_summary FROM summary WHERE correlation_state = 'correlated'")
def c1(spark, d):
    return questions.correlated_compounds(B.summary(spark, d))


@query("c18_c2_compounds_per_state", "SELECT correlation_state, count(*) AS n_compounds FROM summary GROUP BY 1")
def c2(spark, d):
    return questions.compounds_per_state(B.summary(spark, d))


@query("c18_c3_unmapped_compounds", "SELECT compound_id, signal_summary FROM summary WHERE correlation_state = 'no_mapping'")
def c3(spark, d):
    return questions.unmapped_compounds(B.summary(spark, d))


def _registered(spark, d, prefix):
    flags = B.written_flags(spark, d)
    return question_functions.register_questions(
        spark, B.readings(spark, d), flags, B.reference(spark), B.compound_registry(spark, d),
        correlate.public_summary(B.correlation(spark, d, flags)), prefix)


@query("c18_sql_last_readings", """
    SELECT * FROM (SELECT compound_id, sample_id, assay_name, result_value, result_unit, acquired_ts,
      CAST(row_number() OVER (ORDER BY acquired_ts DESC, sample_id) AS INT) AS recency FROM readings
      WHERE compound_id = 'CMPD00012') WHERE recency <= 5""")
def sql_last_readings(spark, d):
    _registered(spark, d, "q2_")
    return spark.sql("SELECT * FROM q2_last_readings('CMPD00012', n => 5)")


@query("c18_sql_lateral", """
    SELECT t.assay_name, f.compound_id, f.reading_id, m.n, round(m.mean_value, 6) AS mean_value FROM thresholds t
    JOIN flags f ON f.is_flagged AND f.assay_name = t.assay_name AND f.result_value < t.concern_threshold / 2
    JOIN (SELECT compound_id, assay_name, count(*) AS n, avg(result_value) AS mean_value FROM readings GROUP BY 1, 2) m
      ON m.assay_name = t.assay_name AND m.compound_id = f.compound_id""")
def sql_lateral(spark, d):
    """Two questions asked for each row of the reference."""
    _registered(spark, d, "q7_")
    B.reference(spark).createOrReplaceTempView("q7_reference")
    return spark.sql("""
        SELECT t.assay_name, f.compound_id, f.reading_id, m.n, round(m.mean_value, 6) AS mean_value
        FROM q7_reference t, LATERAL q7_flagged_in_assay(t.assay_name, t.concern_threshold / 2) f,
          LATERAL q7_average_per_compound(t.assay_name) m WHERE m.compound_id = f.compound_id""")


@query("c18_sql_counts", """
    SELECT 'currently_flagged' AS question, count(*) AS n_rows FROM flags WHERE is_flagged
    UNION ALL SELECT 'against_threshold', count(*) FROM readings JOIN thresholds USING (assay_name)
    UNION ALL SELECT 'most_flagged_assay', count(*) FROM (SELECT rank() OVER (ORDER BY count(*) DESC) AS r FROM flags
      WHERE is_flagged GROUP BY assay_name) WHERE r = 1
    UNION ALL SELECT 'registry_size', 1
    UNION ALL SELECT 'concern_thresholds', count(*) FROM thresholds
    UNION ALL SELECT 'correlated_compounds', count(*) FROM summary WHERE correlation_state = 'correlated'
    UNION ALL SELECT 'compounds_per_state', count(DISTINCT correlation_state) FROM summary
    UNION ALL SELECT 'unmapped_compounds', count(*) FROM summary WHERE correlation_state = 'no_mapping'
    UNION ALL SELECT 'last_readings', sum(least(n, 3))::BIGINT FROM (SELECT count(*) AS n FROM readings GROUP BY compound_id)
    UNION ALL SELECT 'flagged_in_assay', count(*) FROM flags WHERE is_flagged AND assay_name = 'error'
    UNION ALL SELECT 'average_per_compound', count(DISTINCT compound_id) FROM readings WHERE assay_name = 'error'""")
def sql_counts(spark, d):
    """All eleven functions called from SQL, with the number of rows that each returns."""
    named = [n.removeprefix("q_") for n in _registered(spark, d, "q_")]
    given = {"flagged_in_assay": "'error'", "average_per_compound": "'error'"}
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS question, count(1) AS n_rows FROM q_{n}({given.get(n, '')})" for n in named))


@query("c19_clinical_summary", "SELECT * FROM summary WHERE compound_id = 'CMPD00012'")
def clinical_summary(spark, d):
    return lookups.clinical_summary(spark, B.summary(spark, d), "CMPD00012")


@query("c19_pair_history", """
    SELECT assay_name, result_value, result_unit, strftime(acquired_ts, '%Y-%m-%d %H:%M:%S.%f') AS acquired_ts, qc_flag
    FROM readings WHERE compound_id = 'CMPD00003' AND assay_name = 'purchase'""")
def pair_history(spark, d):
    return lookups.pair_history(spark, B.readings(spark, d), "CMPD00003", "purchase")
