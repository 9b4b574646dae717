"""The known answers of the small fixture, from readings to roll-up and drift."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from sigreview import fixed_values as V
from sigreview.functions.sql_functions import register_check_reading, register_check_signal
from sigreview.functions import sql_functions
from sigreview.operators import advice, correlate, deidentify, drift, kpi, review_queue, rollup, scoring
from sigreview.plans import questions
from sigreview.schemas import QUEUE, RESOLVED_ITEM, REVIEW_TASK

SALT = ":test-salt"


@pytest.fixture(scope="module")
def flags(spark):
    return scoring.score_readings(fx.readings(spark), fx.reference(spark), fx.AS_OF).cache()


@pytest.fixture(scope="module")
def signal(spark, flags):
    obs = deidentify.deidentify(fx.observations(spark), salt=SALT)
    return correlate.correlate(flags, fx.crosswalk(spark), obs, fx.AS_OF).cache()


@pytest.fixture(scope="module")
def queue(spark, flags, signal):
    empty = spark.createDataFrame([], QUEUE)
    return review_queue.sync_queue(empty, flags, signal, fx.AS_OF)[0].cache()


def test_flagged_readings_margins_and_order(queue):
    rows = review_queue.queue_view(queue).collect()
    assert [(r.compound_id, r.assay_name, r.result_value, r.margin, r.compound_prior_mean) for r in rows] == list(fx.FLAGGED)
    placed = review_queue.queue_positions(queue).orderBy("position").collect()
    assert [r.reading_id for r in placed] == [r.reading_id for r in rows]


def test_flag_counts(flags):
    n = {r.assay_name: r.n_flagged for r in scoring.flagged_per_assay(flags).collect()}
    assert n == {"hERG_IC50": 7, "LOGD_7_4": 3, "CYP3A4_IC50": 3, "KINETIC_SOL": 1}
    assert scoring.flag_summary(flags).first().n_flagged == 14
    assert questions.most_flagged_assay(flags).collect()[0].assay_name == "hERG_IC50"


def test_reason_wording(flags):
    by = {(r.compound_id, r.assay_name, r.result_value): r.reason for r in flags.collect()}
    assert by[("CMPD00012", "hERG_IC50", 0.259)] == (
        "FLAGGED: hERG_IC50 reading 0.259 uM breaches synthetic low-concern threshold 1.0 uM "
        "(margin -0.741). Compound prior mean 0.264 over 2 historical readings.")
    assert by[("CMPD00003", "LOGD_7_4", 5.332)].startswith(
        "FLAGGED: LOGD_7_4 reading 5.332  breaches synthetic high-concern threshold 5.0  (margin 0.332).")
    assert by[("CMPD00001", "hERG_IC50", 5.0)] == (
        "OK: hERG_IC50 reading 5.0 uM within synthetic low-concern threshold 1.0 uM (margin 4.0).")
    assert by[("CMPD00001", "OTHER", 3.0)] == "OK: no synthetic reference threshold defined for assay OTHER"


@pytest.mark.parametrize("assay,value,expected", [
    ("hERG_IC50", 0.5, True), ("hERG_IC50", 5.0, False), ("hERG_IC50", 1.0, False),
    ("LOGD_7_4", 6.0, True), ("LOGD_7_4", 4.0, False), ("LOGD_7_4", 5.0, False), ("NONE", 0.1, False),
])
def test_decision_matrix_through_the_sql_function(spark, assay, value, expected):
    fx.readings(spark).createOrReplaceTempView("g_readings")
    fx.reference(spark).createOrReplaceTempView("g_reference")
    register_check_reading(spark, "g_readings", "g_reference")
    row = spark.sql("SELECT check_reading('CMPD99999', :a, :v, 'uM') AS v", args={"a": assay, "v": value}).first().v
    assert row.is_flagged is expected
    assert row.compound_prior_n == 0 and row.compound_prior_mean is None
    if expected:  # without history the reading itself stands in
        assert f"prior mean {value} over 0" in row.reason


def test_function_and_batch_agree(spark, flags):
    fx.readings(spark).createOrReplaceTempView("g_readings")
    fx.reference(spark).createOrReplaceTempView("g_reference")
    register_check_reading(spark, "g_readings", "g_reference")
    single = spark.sql(
        "SELECT sample_id AS reading_id, check_reading(compound_id, assay_name, result_value, result_unit) AS v FROM g_readings"
    ).select("reading_id", "v.is_flagged", "v.reason", "v.margin", "v.compound_prior_n", "v.compound_prior_mean")
    batch = flags.select(*single.columns)
    assert single.exceptAll(batch).count() == 0 and batch.exceptAll(single).count() == 0


def test_three_states(spark, signal):
    rows = {r.compound_id: r for r in signal.collect()}
    states = {c: (r.correlation_state, r.n_adverse_obs) for c, r in rows.items()}
    assert states == {
        "CMPD00006": (V.CORRELATED, 1), "CMPD00007": (V.CORRELATED, 1), "CMPD00012": (V.CORRELATED, 2),
        "CMPD00004": (V.CHECKED, 0), "CMPD00008": (V.CHECKED, 0),
        "CMPD00003": (V.NO_MAPPING, 0), "CMPD00014": (V.NO_MAPPING, 0), "CMPD00024": (V.NO_MAPPING, 0),
    }
    assert rows["CMPD00012"].signal_detail.endswith("adverse_reaction signal: cardiac_arrhythmia, qt_prolongation")
    assert rows["CMPD00014"].crosswalk_confidence == 0.0
    counts = {r.correlation_state: r.n_compounds for r in correlate.state_counts(signal).collect()}
    assert counts == {V.CORRELATED: 3, V.CHECKED: 2, V.NO_MAPPING: 3}


def test_signal_function_agrees(spark, signal):
    fx.crosswalk(spark).createOrReplaceTempView("g_crosswalk")
    deidentify.deidentify(fx.observations(spark), salt=SALT).createOrReplaceTempView("g_observations")
    register_check_signal(spark, "g_crosswalk", "g_observations")
    signal.createOrReplaceTempView("g_signal")
    for row in spark.sql("SELECT *, check_signal(compound_id) AS v FROM g_signal").collect():
        assert (row.v.state, row.v.drug_code, row.v.n_adverse_obs, row.v.signal_detail) == (
            row.correlation_state, row.drug_code, row.n_adverse_obs, row.signal_detail)


def test_crosswalk_marks(spark):
    obs = deidentify.deidentify(fx.observations(spark), salt=SALT)
    seen = fx.readings(spark).select("compound_id").distinct()
    rows = correlate.validate_crosswalk(fx.crosswalk(spark), obs, seen).collect()
    assert len(rows) == 7 and all(r.drug_code_seen_in_clinical and r.compound_seen_in_registry for r in rows)
    none = correlate.validate_crosswalk(fx.crosswalk(spark), obs.limit(0), seen.limit(0)).collect()
    assert [r.drug_code_seen_in_clinical for r in none if r.drug_code is None] == [True]
    assert not any(r.drug_code_seen_in_clinical for r in none if r.drug_code)
    assert not any(r.compound_seen_in_registry for r in none)


def test_rollup_order_and_convergence(queue):
    shown = queue.where(~F.col("compound_id").isin("CMPD00003", "CMPD00012") & (F.col("margin") != -0.012))
    order = [r.compound_id for r in rollup.risk_positions(shown).orderBy("position").collect()]
    assert order == ["CMPD00007", "CMPD00006", "CMPD00004", "CMPD00008", "CMPD00014", "CMPD00024"]
    c = kpi.convergence(shown).first()
    assert (c.compounds_open, c.correlated, c.convergence_rate, c.correlation_rate_of_mapped) == (6, 2, 0.3333, 0.5)


def test_convergence_of_an_empty_queue_is_null(spark):
    c = kpi.convergence(spark.createDataFrame([], QUEUE)).first()
    assert c.compounds_open == 0 and c.convergence_rate is None and c.correlation_rate_of_mapped is None


def test_nested_readings_come_whole_in_parts(queue):
    whole = {r.compound_id: r.readings for r in rollup.rollup_readings(queue).collect()}
    assert [round(abs(x.margin), 4) for x in whole["CMPD00004"]] == [0.348, 0.291, 0.283]
    parts = rollup.rollup_readings(queue, per_part=2).where("compound_id = 'CMPD00004'").orderBy("part").collect()
    assert [len(p.readings) for p in parts] == [2, 1]
    assert [x for p in parts for x in p.readings] == whole["CMPD00004"]


def test_prompts_in_parts_hold_every_breach(flags, signal):
    one = advice.breach_texts(flags).where("compound_id = 'CMPD00004'").first()
    parts = advice.breach_texts(flags, per_part=1).where("compound_id = 'CMPD00004'").orderBy("part").collect()
    assert one.n_flags == 3 and [p.n_flags for p in parts] == [3, 3, 3]
    assert "; ".join(p.breaches for p in parts) == one.breaches
    prompt = advice.recommendation_prompts(flags, signal, fx.AS_OF, "m").where("compound_id = 'CMPD00012'").first()
    assert "2 adverse observation(s)" in prompt.recommendation_input and one.breaches.count("threshold") == 3


def test_a_compound_far_above_the_part_size(spark):
    """5,000 flags in parts of 1,000: every breach once, every reason once, one action."""
    rows = [("C", f"r{i:05}", "A", float(i % 700), 1.0, float(i), f"reason {i % 40}") for i in range(5000)]
    flags = spark.createDataFrame(rows, "compound_id string, reading_id string, assay_name string, result_value double, "
                                        "threshold double, margin double, reason string").withColumn("is_flagged", F.lit(True))
    parts = advice.breach_texts(flags).orderBy("part").collect()
    assert [p.part for p in parts] == [1, 2, 3, 4, 5] and {p.n_flags for p in parts} == {5000}
    assert sum(p.breaches.count("vs threshold") for p in parts) == 5000
    reasons = [r for p in parts for r in p.reason_text.split(" || ") if r]
    assert sorted(reasons) == sorted({r[-1] for r in rows})
    signal = spark.createDataFrame([("C", None, None, None)], "compound_id string, correlation_state string, n_adverse_obs long, signal_detail string")
    prompts = advice.recommendation_prompts(flags, signal, fx.AS_OF, "m")
    model = lambda p: p.str.contains("reason 39", regex=False).map(
        {True: "ACTION: deprioritize\nRATIONALE: first part", False: "ACTION: proceed\nRATIONALE: other"})
    one = advice.one_action(advice.checked_replies(advice.recommend(prompts, model))).collect()
    assert [(r.compound_id, r.action, r.rationale, r.n_parts) for r in one] == [("C", "deprioritize", "first part", 5)]
    bad = advice.one_action(advice.checked_replies(prompts.withColumn("recommendation", F.lit("no"))))
    assert [(r.action, r.is_valid) for r in bad.collect()] == [(None, False)]


def test_functions_agree_with_the_batch(spark):
    """Also for NaN, values no decimal holds, and pairs without a history."""
    values = [("C1", 2.0), ("C1", 4.0), ("C1", float("nan")), ("C2", 1.0), ("C2", 1e17), ("C3", 0.5)]
    readings = spark.createDataFrame([(f"s{i}", c, "hERG_IC50", v, "uM", fx.AS_OF) for i, (c, v) in enumerate(values)],
                                     "sample_id string, compound_id string, assay_name string, result_value double, result_unit string, acquired_ts timestamp_ntz")
    past = scoring.history(readings.where("compound_id != 'C3'"))
    batch = {r.reading_id: r for r in scoring.score_readings(readings, fx.reference(spark), fx.AS_OF, past).collect()}
    sql_functions.register_check_reading(spark, readings, fx.reference(spark), "t_check", past)
    readings.createOrReplaceTempView("t_checked")
    rows = spark.sql("SELECT sample_id, t_check(compound_id, assay_name, result_value, result_unit) AS v FROM t_checked").collect()
    for r in rows:
        b = batch[r.sample_id]
        for mine, theirs in (("is_flagged", "is_flagged"), ("reason", "reason"), ("margin", "margin"), ("compound_prior_n", "compound_prior_n"),
                             ("compound_prior_mean", "compound_prior_mean"), ("threshold", "threshold")):
            assert str(r.v[mine]) == str(b[theirs])
    assert batch["s5"].reason and "0.5" in batch["s5"].reason and batch["s5"].compound_prior_mean is None


def test_signal_function_joins_no_raw_observations(spark):
    obs = deidentify.deidentify(fx.observations(spark), salt=SALT)
    sql_functions.register_check_signal(spark, fx.crosswalk(spark), obs, "t_signal")
    fx.crosswalk(spark).select("compound_id").distinct().createOrReplaceTempView("t_compounds")
    df = spark.sql("SELECT compound_id, t_signal(compound_id) AS v FROM t_compounds")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("observation_type"):] if "observation_type" in plan else plan
    assert "Join" not in below  # observations are aggregated before any join
    direct = {r.compound_id: r.correlation_state for r in correlate.signals(
        spark.table("t_compounds"), fx.crosswalk(spark), obs, fx.AS_OF).collect()}
    assert {r.compound_id: r.v.state for r in df.collect()} == direct


def test_every_flag_has_a_reason_without_history(spark):
    flags = scoring.score_readings(fx.readings(spark), fx.reference(spark), fx.AS_OF, scoring.history(fx.readings(spark).limit(0)))
    assert flags.where("is_flagged").count() == 14 and flags.where("reason IS NULL").count() == 0
    assert flags.where("compound_prior_mean IS NOT NULL OR compound_prior_n != 0").count() == 0


def test_masks(spark):
    obs = deidentify.deidentify(fx.observations(spark), salt=SALT)
    outside = deidentify.govern(obs, groups=["chemists"]).collect()
    assert len(outside) == 3
    assert {r.value for r in outside} == {V.REDACTED_VALUE}
    assert all(r.patient_pseudonym.startswith("anon-") and len(r.patient_pseudonym) == 15 for r in outside)
    inside = deidentify.govern(obs, groups=[V.CLINICAL_GROUP])
    assert inside.exceptAll(obs).count() == 0 and inside.count() == obs.count()


def _resolved(spark, outcomes):
    rows = []
    for i, (assay, reason) in enumerate(outcomes):
        rows.append((str(i), "C", assay, 1.0, "uM", 1.0, -0.1, "r", reason, "me",
                     datetime(2026, 9, 14, 10, i), datetime(2026, 9, 14, 9, 0), None))
    return spark.createDataFrame(rows, RESOLVED_ITEM)


OUTCOMES = (
    [("CYP3A4_IC50", V.FALSE_POSITIVE), ("CYP3A4_IC50", V.CONFIRMED)]
    + [("LOGD_7_4", V.FALSE_POSITIVE), ("LOGD_7_4", V.ESCALATED)]
    + [("hERG_IC50", V.FALSE_POSITIVE)] * 2 + [("hERG_IC50", V.CONFIRMED), ("hERG_IC50", V.ESCALATED)]
)


def test_kpis_and_drift(spark):
    items = _resolved(spark, OUTCOMES)
    k = kpi.triage_kpis(items).first()
    assert (k.resolved_count, k[V.FALSE_POSITIVE], k[V.CONFIRMED], k[V.ESCALATED], k.false_positive_rate) == (8, 4, 2, 2, 0.5)
    assert k.median_seconds == 3600 + 3.5 * 60 and k.median_hours == 1.06
    day = datetime(2026, 9, 25, 12)
    rates, tasks = drift.drift_check(items, spark.createDataFrame([], REVIEW_TASK), day)
    assert {r.assay_name: r.label for r in rates.collect()} == {
        "CYP3A4_IC50": V.DRIFT_INSUFFICIENT, "LOGD_7_4": V.DRIFT_INSUFFICIENT, "hERG_IC50": V.DRIFT}
    task = tasks.first()
    assert task.task_id == "tr-hERG_IC50-2026-09-25" and task.status == V.OPEN
    assert task.suggested_action == (
        "Review hERG_IC50 deterministic threshold: 2/4 recent flags were resolved as false positives (FPR 50% > 20%).")
    done = tasks.withColumn("status", F.lit("done"))
    _, again = drift.drift_check(items, done, day)
    assert again.count() == 1 and again.first().status == V.OPEN
    _, next_day = drift.drift_check(items, done, datetime(2026, 9, 26))
    assert next_day.count() == 2


def test_drift_is_strict(spark):
    items = _resolved(spark, [("A", V.FALSE_POSITIVE)] + [("A", V.CONFIRMED)] * 4)
    assert drift.drift_rates(items, 0.2, 5).first().label == V.DRIFT_OK
    assert drift.drift_rates(items, 0.19, 5).first().label == V.DRIFT
    assert drift.drift_rates(items, 0.19, 6).first().label == V.DRIFT_INSUFFICIENT


def test_kpis_of_nothing(spark):
    k = kpi.triage_kpis(spark.createDataFrame([], RESOLVED_ITEM)).first()
    assert k.resolved_count == 0 and k.median_seconds is None and k.false_positive_rate is None
