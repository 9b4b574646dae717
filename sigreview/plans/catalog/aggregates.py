"""Aggregations."""

from datetime import date

from pyspark.sql import functions as F

from ...operators import advice, correlate, day_sketches, drift, kpi, quality, registry, review_queue, rollup
from ...operators import scoring, spread
from ...session import pin
from .. import bindings as B
from .. import questions
from .base import query


@query("a1_registry", """
    SELECT compound_id, count(*) AS n_readings, count(DISTINCT assay_name) AS n_assays,
      min(acquired_ts) AS first_seen, max(acquired_ts) AS last_seen FROM readings GROUP BY compound_id""")
def registry_counts(spark, d):
    return registry.registry(B.readings(spark, d), "compound_id", "acquired_ts", "assay_name", "n_readings", "n_assays")


@query("a2_history", "SELECT compound_id, assay_name, prior_n, round(prior_mean, 6) AS prior_mean FROM hist")
def history(spark, d):
    return scoring.history(B.readings(spark, d)).withColumn("prior_mean", F.round("prior_mean", 6))


@query("a3_crosswalk_collapse", """
    SELECT x.*, b.drug_code AS best_drug_code, b.confidence AS best_confidence FROM xw x JOIN (
      SELECT compound_id, drug_code, confidence FROM seed QUALIFY row_number() OVER (
        PARTITION BY compound_id ORDER BY confidence DESC, drug_code DESC NULLS LAST) = 1) b USING (compound_id)""")
def crosswalk_collapse(spark, d):
    seed = B.crosswalk_seed(spark, d)
    best = correlate.collapse_crosswalk(seed, coherent=True).select(
        "compound_id", F.col("drug_code").alias("best_drug_code"),
        F.col("crosswalk_confidence").alias("best_confidence"))
    return correlate.collapse_crosswalk(seed).join(best, "compound_id")


@query("a4_adverse_rollup", "SELECT compound_id, n_adverse, terms FROM adverse")
def adverse_rollup(spark, d):
    return correlate.adverse_by_compound(B.crosswalk_seed(spark, d), B.observations(spark, d))


@query("a5_breach_texts", "SELECT * FROM breach_parts")
def breach_texts(spark, d):
    return advice.breach_texts(B.flags(spark, d))


@query("a5_small_parts", "SELECT * FROM small_breach_parts")
def small_parts(spark, d):
    """The same texts two flags to a row, so that compounds have several parts."""
    return advice.breach_texts(B.flags(spark, d), per_part=2)


@query("a7_filtered_counts", """
    SELECT count(*) AS resolved_count, count(*) FILTER (WHERE resolution_reason = 'false_positive') AS false_positive,
      count(*) FILTER (WHERE resolution_reason = 'confirmed_concern') AS confirmed_concern,
      count(*) FILTER (WHERE resolution_reason = 'escalated_for_confirmatory_assay') AS escalated_for_confirmatory_assay
    FROM items""")
def filtered_counts(spark, d):
    return kpi.outcome_counts(B.resolved_items(spark, d))


_SECONDS = "epoch(resolved_ts - flagged_ts)"


@query("a8_exact_percentiles", f"""
    SELECT round(quantile_cont({_SECONDS}, 0.5), 6) AS median_seconds, round(quantile_cont({_SECONDS}, 0.9), 6) AS p90_seconds
    FROM items WHERE flagged_ts IS NOT NULL""")
def exact_percentiles(spark, d):
    times = kpi.cycle_times(B.resolved_items(spark, d))
    return times.select(*[F.round(c, 6).alias(c) for c in times.columns])


@query("a8_percentiles_per_assay", """
    SELECT assay_name, round(quantile_cont(result_value, 0.5), 6) AS median_value,
      round(quantile_cont(result_value, 0.9), 6) AS p90_value FROM readings GROUP BY assay_name""")
def percentiles_per_assay(spark, d):
    p = spread.exact_percentiles(B.readings(spark, d).select("assay_name", "result_value"), "result_value",
                    {"median_value": 0.5, "p90_value": 0.9}, group=["assay_name"])
    return p.select("assay_name", F.round("median_value", 6).alias("median_value"),
                    F.round("p90_value", 6).alias("p90_value"))


# The last ten days of the readings.
_LAST, _DAYS = date(2024, 1, 28), 10
_WINDOW = "acquired_ts >= TIMESTAMP '2024-01-19 00:00:00' AND acquired_ts < TIMESTAMP '2024-01-29 00:00:00'"
_POINTS = {"p10": 0.1, "median_value": 0.5, "p90": 0.9}


def _sketched(spark, d):
    """Sketches of two batches of readings, the second of which adds to the days of the first, written once."""
    rows = B.readings(spark, d)
    lots = [day_sketches.day_sketches(rows.where(f"CAST(sample_id AS BIGINT) % 2 = {k}"), "acquired_ts", "result_value", ["compound_id"])
            for k in (0, 1)]
    whole = pin(day_sketches.merged(lots[0].unionByName(lots[1]), ["assay_name", "day"]))
    return day_sketches.window(whole, _LAST, _DAYS)


@query("a8_day_quantiles", f"""
    SELECT assay_name, point, count(result_value) AS n_values, TRUE AS within_bound
    FROM readings, (VALUES ('p10'), ('median_value'), ('p90')) p(point) WHERE {_WINDOW} GROUP BY ALL""")
def day_quantiles(spark, d):
    """Quantiles of a window from its days' sketches, and whether their exact ranks are within twice the stated error."""
    told = pin(day_sketches.answers(_sketched(spark, d), _POINTS))
    rows = B.readings(spark, d).where(_WINDOW.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")).select("assay_name", "result_value")
    counted = rows.join(F.broadcast(told), "assay_name").groupBy("assay_name").agg(
        F.first("n_values").alias("n_values"),
        *[F.expr(f"count_if(result_value {sign} {name}) / count(result_value) AS {part}_{name}")
          for name in _POINTS for sign, part in (("<", "below"), ("<=", "upto"))])
    slack = 2 * day_sketches.rank_error()
    near = ", ".join(f"'{n}', below_{n} - {slack} <= {p} AND {p} <= upto_{n} + {slack}" for n, p in _POINTS.items())
    return counted.selectExpr("assay_name", f"explode(map({near})) AS (point, within_bound)", "n_values")


@query("a1_distinct_sketches", f"""
    SELECT assay_name, count(*) AS n_rows, count(DISTINCT compound_id) AS n_exact, TRUE AS within_bound
    FROM readings WHERE {_WINDOW} GROUP BY assay_name""")
def distinct_sketches(spark, d):
    """Compounds of a window by its days' sketches, within four standard errors (and one) of the exact number."""
    rows = B.readings(spark, d).where(_WINDOW.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))
    exact = rows.groupBy("assay_name").agg(F.expr("count(DISTINCT compound_id) AS n_exact"))
    told = day_sketches.answers(_sketched(spark, d), {}).join(exact, "assay_name")
    slack = 4 * day_sketches.distinct_error()
    return told.selectExpr("assay_name", "n_rows", "n_exact", f"abs(n_compound_id - n_exact) <= 1 + {slack} * n_exact AS within_bound")


@query("a9_bool_or_max", """
    SELECT compound_id, bool_or(is_flagged) AS any_flagged, max(concern_direction) AS direction,
      max(threshold_unit) AS unit FROM flags GROUP BY compound_id""")
def bool_or_max(spark, d):
    return B.flags(spark, d).groupBy("compound_id").agg(
        F.bool_or("is_flagged").alias("any_flagged"), F.max("concern_direction").alias("direction"),
        F.max("threshold_unit").alias("unit"))


@query("a10_compound_totals", "SELECT * FROM totals")
def compound_totals(spark, d):
    return rollup.compound_totals(B.queue(spark, d))


@query("a11_status_counts", "SELECT status, count(*) AS n FROM merged GROUP BY status")
def status_counts(spark, d):
    return review_queue.status_counts(B.queue(spark, d))


@query("a11_state_counts", "SELECT correlation_state, count(*) AS n_compounds FROM correlation GROUP BY correlation_state")
def state_counts(spark, d):
    return correlate.state_counts(B.correlation(spark, d))


CONVERGENCE = """
    SELECT count(*) AS compounds_open, count(*) FILTER (WHERE clinical_correlation_state = 'correlated') AS correlated,
      count(*) FILTER (WHERE clinical_correlation_state = 'checked_no_correlation') AS checked_no_correlation,
      count(*) FILTER (WHERE coalesce(clinical_correlation_state, 'no_mapping') = 'no_mapping') AS no_mapping,
      round(count(*) FILTER (WHERE clinical_correlation_state = 'correlated') / CAST(count(*) AS DOUBLE), 4) AS convergence_rate,
      round(count(*) FILTER (WHERE clinical_correlation_state = 'correlated') / CAST(nullif(count(*) FILTER (
        WHERE clinical_correlation_state IN ('correlated', 'checked_no_correlation')), 0) AS DOUBLE), 4) AS correlation_rate_of_mapped
    FROM totals"""


@query("a12_convergence", CONVERGENCE)
def convergence(spark, d):
    return kpi.convergence(B.queue(spark, d))


TRIAGE = f"""
    SELECT count(*) AS resolved_count, count(*) FILTER (WHERE resolution_reason = 'false_positive') AS false_positive,
      count(*) FILTER (WHERE resolution_reason = 'confirmed_concern') AS confirmed_concern,
      count(*) FILTER (WHERE resolution_reason = 'escalated_for_confirmatory_assay') AS escalated_for_confirmatory_assay,
      round(quantile_cont({_SECONDS}, 0.5), 6) AS median_seconds, round(quantile_cont({_SECONDS}, 0.9), 6) AS p90_seconds,
      round(quantile_cont({_SECONDS}, 0.5) / 3600, 2) AS median_hours, round(quantile_cont({_SECONDS}, 0.9) / 3600, 2) AS p90_hours,
      round(count(*) FILTER (WHERE resolution_reason = 'false_positive') / CAST(count(*) AS DOUBLE), 4) AS false_positive_rate
    FROM items"""


@query("a13_triage_kpis", TRIAGE)
def triage_kpis(spark, d):
    k = kpi.triage_kpis(B.resolved_items(spark, d))
    return k.withColumns({c: F.round(c, 6) for c in ("median_seconds", "p90_seconds")})


@query("a14_outcome_mix", """
    SELECT resolution_reason, n, round(n * 100 / CAST(sum(n) OVER () AS DOUBLE), 6) AS percent
    FROM (SELECT resolution_reason, count(*) AS n FROM items GROUP BY 1)""")
def outcome_mix(spark, d):
    return kpi.outcome_mix(B.resolved_items(spark, d)).withColumn("percent", F.round("percent", 6))


BY_ASSAY = """
    SELECT assay_name, open_flags, CAST(sum(open_flags) OVER () AS BIGINT) AS total_flags,
      round(open_flags * 100 / CAST(greatest(1, max(open_flags) OVER ()) AS DOUBLE), 6) AS percent_of_largest
    FROM (SELECT assay_name, count(*) AS open_flags FROM prior_queue WHERE status = 'open'
      AND flagged_ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY GROUP BY 1)"""


@query("a15_flags_by_assay", BY_ASSAY)
def flags_by_assay(spark, d):
    return kpi.flags_by_assay(B.prior_queue(spark, d), 7, B.AS_OF).withColumn(
        "percent_of_largest", F.round("percent_of_largest", 6))


@query("a16_flag_summary", """
    SELECT count(*) AS n_readings, CAST(sum(CAST(is_flagged AS INT)) AS BIGINT) AS n_flagged,
      count(*) FILTER (WHERE NOT is_flagged) AS n_not_flagged FROM flags""")
def flag_summary(spark, d):
    return scoring.flag_summary(B.flags(spark, d))


@query("a17_drift_rates", "SELECT * REPLACE (round(observed_fpr, 6) AS observed_fpr) FROM drift")
def drift_rates(spark, d):
    return drift.drift_rates(B.resolved_items(spark, d), B.TOLERANCE).withColumn("observed_fpr", F.round("observed_fpr", 6))


@query("a17_drift_insufficient", """
    SELECT assay_name, compound_id, count(*) AS n_resolved,
      count(*) FILTER (WHERE resolution_reason = 'false_positive') AS n_false_positive,
      round(count(*) FILTER (WHERE resolution_reason = 'false_positive') / CAST(count(*) AS DOUBLE), 6) AS observed_fpr,
      CASE WHEN count(*) < 10 THEN 'insufficient'
        WHEN count(*) FILTER (WHERE resolution_reason = 'false_positive') / CAST(count(*) AS DOUBLE) > 0.335 THEN 'drift'
        ELSE 'ok' END AS label FROM items GROUP BY assay_name, compound_id""")
def drift_insufficient(spark, d):
    rates = drift.drift_rates(B.resolved_items(spark, d), B.TOLERANCE, 10, by=("assay_name", "compound_id"))
    return rates.withColumn("observed_fpr", F.round("observed_fpr", 6))


@query("a18_bronze_profile", """
    SELECT count(*) AS n_rows, count(DISTINCT compound_id) AS n_compounds, count(DISTINCT assay_name) AS n_assays,
      min(acquired_ts) AS first_ts, max(acquired_ts) AS last_ts FROM dirty""")
def bronze_profile(spark, d):
    return quality.bronze_profile(B.dirty_readings(spark, d))


@query("a18_assay_profile", """
    SELECT assay_name, count(*) AS n, min(result_value) AS min_value, max(result_value) AS max_value
    FROM dirty GROUP BY assay_name""")
def assay_profile(spark, d):
    return quality.assay_profile(B.dirty_readings(spark, d))


@query("a19_average_per_compound", """
    SELECT compound_id, round(avg(result_value), 6) AS mean_value, count(*) AS n FROM readings
    WHERE assay_name = 'error' GROUP BY compound_id""")
def average_per_compound(spark, d):
    return questions.average_per_compound(B.readings(spark, d), "error").withColumn("mean_value", F.round("mean_value", 6))


@query("a20_cycle_by_outcome", f"""
    SELECT resolution_reason, count(*) AS n, round(avg({_SECONDS}) / 3600, 6) AS mean_hours FROM items
    WHERE flagged_ts IS NOT NULL GROUP BY resolution_reason""")
def cycle_by_outcome(spark, d):
    return kpi.cycle_by_outcome(B.resolved_items(spark, d)).withColumn("mean_hours", F.round("mean_hours", 6))
