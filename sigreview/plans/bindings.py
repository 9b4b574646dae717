"""The given tables in the roles of the operators: readings, observations, logs.

Each role is a projection or grouping of whole tables; FIXTURES.md lists them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import stamp
from ..operators import actions, correlate, deidentify, registry, review_queue, scoring
from ..schemas import QUEUE, RESOLVED_ITEM
from ..session import pin
from ..sources import envelope
from ..sources.tables import threshold_table

SALT = ":sigreview-test-salt"
MODEL = "stub-model"

# Bound thresholds: (assay, direction, threshold, unit); the type "view" has none.
CURRENT = (
    ("error", V.LOW, 1.0, "uM"),
    ("click", V.LOW, 1.0, "uM"),
    ("purchase", V.LOW, 10.0, "uM"),
    ("signup", V.HIGH, 200.0, ""),
)
# An earlier calibration, which the prior queue was filled with.
EARLIER = (
    ("error", V.LOW, 1.5, "uM"),
    ("click", V.LOW, 0.8, "uM"),
    ("purchase", V.LOW, 8.0, "uM"),
    ("signup", V.HIGH, 190.0, ""),
)
TOLERANCE = 0.335


AS_OF = datetime(2024, 1, 31)
EARLIER_STAMP = datetime(2024, 1, 30)

# The number in the JSON text column props.
CODE = "from_json(props, 'k INT').k"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events")


_READING = {
    "sample_id": "CAST(event_id AS STRING)",
    "compound_id": "format_string('CMPD%05d', user_id)",
    "plate": "concat('P', 1 + user_id % 6)",
    "well": "concat(char(65 + event_id % 8), lpad(CAST(1 + event_id % 12 AS STRING), 2, '0'))",
    "replicate": "CAST(1 + event_id % 2 AS INT)",
    "assay_name": "event_type",
    "result_value": "value",
    "result_unit": "CASE WHEN event_type = 'signup' THEN '' ELSE 'uM' END",
    "acquired_ts": "ts",
    "assay_protocol": "concat('proto-', event_type)",
    "operator_id": f"concat('op-', {CODE})",
    "batch_guid": "md5(CAST(event_id AS STRING))",
    "qc_flag": f"CASE WHEN {CODE} < 25 THEN 'REVIEW' ELSE 'PASS' END",
}


def readings_of(e: DataFrame, *extra: str, **other: str) -> DataFrame:
    """Event rows as readings, with other expressions for some columns."""
    return e.selectExpr(*[f"{sql} AS {name}" for name, sql in (_READING | other).items()], *extra)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_of(events(spark, sf_dir))


def dirty_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings where some values are missing or out of range, by the code in props."""
    kind = f"CASE WHEN {CODE} <> 1 THEN event_type END"
    return readings_of(
        events(spark, sf_dir),
        compound_id=f"CASE WHEN {CODE} <> 0 THEN format_string('CMPD%05d', user_id) END",
        assay_name=kind,
        result_unit=f"CASE WHEN {kind} = 'signup' THEN '' ELSE 'uM' END",
        assay_protocol=f"concat('proto-', {kind})",
        acquired_ts=f"CASE WHEN {CODE} <> 2 THEN ts END",
        result_value=f"CASE WHEN {CODE} = 4 THEN -value WHEN {CODE} = 5 THEN value * 1e6D "
                     f"WHEN {CODE} <> 3 THEN value END",
    )


def composite_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings whose sample id is the vendor's composite id; some are malformed.

    event_id stays as the sort key of the pages.  The vendor's ids have five digits, so only here do users
    share a compound from 100,000 on.
    """
    vendor = _READING | {"compound_id": "format_string('CMPD%05d', user_id % 100000)"}
    good = "concat('LO-', {compound_id}, '-', {plate}, '-', {well}, '-R', {replicate})".format(**vendor)
    return readings_of(
        events(spark, sf_dir), "event_id", compound_id=vendor["compound_id"],
        sample_id=f"CASE WHEN {CODE} = 6 THEN concat('bad-', event_id) ELSE {good} END",
    )


def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.write_envelopes(composite_readings(spark, sf_dir), order=("event_id",))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.parse_pages(page_bodies(spark, sf_dir))


def reference(spark: SparkSession, rows=CURRENT) -> DataFrame:
    return threshold_table(spark, [(a, d, t, u, "bound for checks", True) for a, d, t, u in rows])


def flags(
    spark: SparkSession, sf_dir: str, rows=CURRENT, as_of: datetime = AS_OF, past: DataFrame | None = None
) -> DataFrame:
    return scoring.score_readings(readings(spark, sf_dir), reference(spark, rows), as_of, past)


def written_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as a written stage, for jobs that score more than once."""
    return pin(scoring.history(readings(spark, sf_dir)))


def empty_queue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], QUEUE)


def no_signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "compound_id string, correlation_state string, drug_code string, signal_detail string")


def raw_observations(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Orders as clinical observations; small orders lack the drug code."""
    adverse = "o_orderpriority = '1-URGENT' AND o_custkey % 3 = 0"
    return load(spark, sf_dir, "orders").selectExpr(
        "concat('pt-', o_custkey) AS patient_ref",
        "CASE WHEN o_totalprice < 5000 THEN NULL WHEN o_custkey % 40 = 0 THEN 'DRG-0777' "
        "ELSE format_string('DRG-%04d', o_custkey % 300) END AS drug_code",
        f"CASE WHEN {adverse} THEN '{V.ADVERSE}' ELSE '{V.LAB_RESULT}' END AS observation_type",
        f"CASE WHEN NOT ({adverse}) THEN concat('level ', o_orderstatus) "
        "WHEN o_orderstatus = 'F' THEN 'cardiac_arrhythmia' "
        "WHEN o_orderstatus = 'O' THEN 'qt_prolongation' ELSE 'mild_rash' END AS value",
        "o_orderdate AS effective_ts", *extra,
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deidentify.deidentify(raw_observations(spark, sf_dir), salt=SALT)


def crosswalk_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings for every user with a reading of at least 200; some ambiguous,
    some unresolved, some with a second row."""
    users = events(spark, sf_dir).groupBy("user_id").agg(F.max("value").alias("top"))
    main = (
        "named_struct('drug_code', CASE WHEN user_id % 4 < 2 THEN format_string('DRG-%04d', user_id) "
        "WHEN user_id % 4 = 2 THEN 'DRG-0777' END, 'mapping_source', CASE WHEN user_id % 4 < 2 "
        "THEN 'one to one' WHEN user_id % 4 = 2 THEN 'ambiguous' ELSE 'unresolved' END, 'confidence', "
        "CASE WHEN user_id % 4 < 2 THEN 1.0D WHEN user_id % 4 = 2 THEN 0.5D ELSE 0.0D END)"
    )
    second = "named_struct('drug_code', 'DRG-0777', 'mapping_source', 'second row', 'confidence', 0.5D)"
    return users.where("top >= 200").selectExpr(
        "format_string('CMPD%05d', user_id) AS compound_id",
        f"inline(CASE WHEN user_id % 25 = 0 THEN array({main}, {second}) ELSE array({main}) END)",
    )


def compound_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.compound_registry(readings(spark, sf_dir))


def correlation(spark: SparkSession, sf_dir: str, flagged: DataFrame | None = None) -> DataFrame:
    return correlate.correlate(
        flags(spark, sf_dir) if flagged is None else flagged,
        crosswalk_seed(spark, sf_dir), observations(spark, sf_dir), AS_OF,
    )


def written_flags(spark: SparkSession, sf_dir: str, past: DataFrame | None = None) -> DataFrame:
    """The flag table as a written stage, for jobs that read it more than once."""
    return pin(flags(spark, sf_dir, past=past))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.public_summary(correlation(spark, sf_dir))


def prior_queue(spark: SparkSession, sf_dir: str, past: DataFrame | None = None) -> DataFrame:
    """The queue an earlier calibration left: open, resolved and cleared rows.

    A queue is a written snapshot, so it is written here too.
    """
    turn = "CAST(reading_id AS BIGINT) % 7"
    at = stamp(EARLIER_STAMP)
    out = {f.name: f.name for f in QUEUE} | {
        "status": f"CASE {turn} WHEN 0 THEN '{V.RESOLVED}' WHEN 1 THEN '{V.CLEARED}' ELSE '{V.OPEN}' END",
        "flagged_ts": "TIMESTAMP_NTZ '2024-01-01 00:00:00' "
                      "+ make_dt_interval(CAST(CAST(reading_id AS BIGINT) % 30 AS INT))",
        "synced_ts": at,
        "resolved_by": f"CASE WHEN {turn} = 0 THEN 'earlier reviewer' END",
        "resolved_ts": f"CASE WHEN {turn} = 0 THEN {at} END",
        "resolution_note": f"CASE WHEN {turn} = 0 THEN 'earlier note' END",
        "resolution_reason": f"CASE WHEN {turn} = 0 THEN '{V.CONFIRMED}' END",
        "clinical_correlation_state": "CAST(NULL AS STRING)",
        "clinical_drug_code": "CAST(NULL AS STRING)",
        "clinical_signal_detail": "CAST(NULL AS STRING)",
    }
    flagged = flags(spark, sf_dir, EARLIER, EARLIER_STAMP, past).where("is_flagged")
    return pin(flagged.selectExpr(*[f"{sql} AS {name}" for name, sql in out.items()]))


def queue_source(spark: SparkSession, sf_dir: str, past: DataFrame | None = None) -> DataFrame:
    flagged = written_flags(spark, sf_dir, past)
    return review_queue.queue_source(flagged, correlation(spark, sf_dir, flagged))


def merged_queue(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    past = written_history(spark, sf_dir)
    return review_queue.merge_queue(
        prior_queue(spark, sf_dir, past), queue_source(spark, sf_dir, past), AS_OF, **options
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_queue(spark, sf_dir).drop("change")


# seq, action, reason, condition on the turn of the reading
_STEPS = (
    (1, "reopen", "NULL", "turn = 2"),
    (2, "resolve", f"CASE WHEN turn = 11 THEN 'bogus' WHEN turn % 3 = 0 THEN '{V.FALSE_POSITIVE}' "
                   f"WHEN turn % 3 = 1 THEN '{V.CONFIRMED}' ELSE '{V.ESCALATED}' END", "TRUE"),
    (3, "resolve", f"'{V.ESCALATED}'", "turn = 3"),
    (4, "reopen", "NULL", "turn >= 4"),
    (5, "resolve", f"'{V.FALSE_POSITIVE}'", "turn >= 8"),
    (6, "reopen", "NULL", "turn = 10"),
)


def action_log(prior: DataFrame) -> DataFrame:
    """Reviewer actions on every row of the prior queue, legal and void ones."""
    steps = ", ".join(
        f"CASE WHEN {wanted} THEN named_struct('seq', {seq}L, 'action', '{action}', "
        f"'resolution_reason', CAST({reason} AS STRING), 'actor', 'reviewer {seq}', "
        f"'action_ts', {stamp(AS_OF)} + make_dt_interval({seq}), 'note', 'note {seq}') END"
        for seq, action, reason, wanted in _STEPS
    )
    turns = prior.selectExpr("reading_id", "assay_name", "CAST(reading_id AS BIGINT) % 12 AS turn")
    return turns.selectExpr("reading_id", "assay_name", f"inline(filter(array({steps}), s -> s IS NOT NULL))")


def acted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queue, resolved log) after the action log; resolved rows are logged already."""
    prior = prior_queue(spark, sf_dir)
    done = prior.where(f"status = '{V.RESOLVED}'").select(*RESOLVED_ITEM.fieldNames())
    return actions.apply_actions(prior, done, action_log(prior))


def resolved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order as resolutions; the flag time is unknown where
    the goods left before the order date."""
    o = load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS l_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    return li.join(o, "l_orderkey").selectExpr(
        "format_string('CMPD%05d', o_custkey) AS compound_id",
        "o_orderpriority AS assay_name",
        f"CASE l_returnflag WHEN 'R' THEN '{V.FALSE_POSITIVE}' WHEN 'A' THEN '{V.CONFIRMED}' "
        f"ELSE '{V.ESCALATED}' END AS resolution_reason",
        "l_shipdate AS resolved_ts",
        "CASE WHEN l_shipdate >= o_orderdate THEN o_orderdate END AS flagged_ts",
    )
