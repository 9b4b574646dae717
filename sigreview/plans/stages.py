"""The whole batch: raw pages to review queue, each stage a written snapshot.

Every stage is read back after writing, so the next one plans on true file
sizes and does not recompute what came before.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators import actions, advice, correlate, deidentify, drift, kpi, quality, registry
from ..operators import review_queue, rollup, scoring
from ..schemas import QUEUE, RESOLVED_ITEM, REVIEW_TASK
from ..sources import envelope, resultset
from ..sources.tables import save_folder


@dataclass
class Batch:
    """Settings of one run.  ``folder`` takes the written stages and must be new
    for each run: the previous queue is read while the next one is written."""

    spark: SparkSession
    folder: str
    as_of: datetime
    salt: str
    model_label: str = "advisory-model"
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.tables[name] = save_folder(df, f"{self.folder.rstrip('/')}/{name}")
        return self.tables[name]

    def empty(self, schema) -> DataFrame:
        return self.spark.createDataFrame([], schema)


def run_readings(batch: Batch, pages: DataFrame, reference: DataFrame) -> None:
    """Bronze, gated silver, quarantine, registry and flags."""
    bronze = batch.keep("assay_results_raw", envelope.ingest_readings(pages))
    valid, quarantine = quality.split_quality(bronze)
    readings = batch.keep("assay_results", valid)
    batch.keep("assay_results_quarantine", quarantine)
    batch.keep("compound_registry", registry.compound_registry(readings))
    batch.keep("assay_flags", scoring.score_readings(readings, reference, batch.as_of))


def run_clinical(batch: Batch, result_sets: DataFrame, crosswalk_seed: DataFrame) -> None:
    """De-identified observations, checked crosswalk, correlation and summary."""
    bronze = batch.keep("ehr_compositions_raw", resultset.ingest_observations(result_sets))
    observations = batch.keep(
        "clinical_observations", deidentify.deidentify(bronze, salt=batch.salt)
    )
    batch.keep("patient_ref_registry", registry.patient_registry(observations))
    crosswalk = batch.keep("compound_drug_crosswalk", correlate.validate_crosswalk(
        crosswalk_seed, observations, batch.tables["compound_registry"]))
    signal = batch.keep("assay_flags_clinical", correlate.correlate(
        batch.tables["assay_flags"], crosswalk, observations, batch.as_of))
    batch.keep("clinical_correlation_summary", correlate.public_summary(signal))


def run_review(
    batch: Batch, queue: DataFrame | None = None, resolved: DataFrame | None = None,
    log: DataFrame | None = None, tasks: DataFrame | None = None,
) -> None:
    """Prompts, queue sync, reviewer actions, roll-up, KPIs and drift tasks."""
    flags, signal = batch.tables["assay_flags"], batch.tables["assay_flags_clinical"]
    batch.keep("recommendation_prompts", advice.recommendation_prompts(
        flags, signal, batch.as_of, batch.model_label))
    merged = batch.keep("queue_changes", review_queue.merge_queue(
        queue if queue is not None else batch.empty(QUEUE),
        review_queue.queue_source(flags, signal), batch.as_of))
    batch.keep("sync_summary", review_queue.sync_summary(merged))
    current = merged.drop("change")
    items = resolved if resolved is not None else batch.empty(RESOLVED_ITEM)
    if log is not None:
        current, items = actions.apply_actions(current, items, log)
    current, items = batch.keep("review_queue", current), batch.keep("resolved_items", items)
    batch.keep("queue_rollup", rollup.queue_rollup(current))
    batch.keep("convergence", kpi.convergence(current))
    batch.keep("triage_kpis", kpi.triage_kpis(items))
    rates, next_tasks = drift.drift_check(
        items, tasks if tasks is not None else batch.empty(REVIEW_TASK), batch.as_of)
    batch.keep("drift_rates", rates)
    batch.keep("threshold_review_tasks", next_tasks)
