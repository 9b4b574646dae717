"""Crosswalk checks and the three-state clinical signal per flagged compound."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import decide
from ..functions.text import stamp
from .spread import join_unique


def known_drugs(observations: DataFrame) -> DataFrame:
    return observations.select("drug_code").where("drug_code IS NOT NULL").distinct()


def validate_crosswalk(
    seed: DataFrame, observations: DataFrame, registry: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """The seed with two marks: is the drug code, is the compound known on its side?

    A NULL drug code counts as seen: there is nothing to look up.
    """
    drugs = known_drugs(observations).selectExpr("*", "TRUE AS _drug_seen")
    compounds = registry.select("compound_id").distinct().selectExpr("*", "TRUE AS _compound_seen")
    marked = join_unique(seed, drugs, ["drug_code"], spread=["compound_id"], hot_rows=hot_rows)
    marked = join_unique(marked, compounds, ["compound_id"],
                         spread=["drug_code", "mapping_source"], hot_rows=hot_rows)
    return marked.selectExpr(
        "compound_id", "drug_code", "mapping_source", "confidence",
        "drug_code IS NULL OR coalesce(_drug_seen, FALSE) AS drug_code_seen_in_clinical",
        "coalesce(_compound_seen, FALSE) AS compound_seen_in_registry",
    )


def collapse_crosswalk(crosswalk: DataFrame, coherent: bool = False) -> DataFrame:
    """One mapping per compound: highest drug code and highest confidence.

    The two maxima may come from different rows; ``coherent`` takes both from
    the most confident row instead.
    """
    if coherent:
        best = F.expr("max(struct(confidence, drug_code)) AS best")
        return crosswalk.groupBy("compound_id").agg(best).selectExpr(
            "compound_id", "best.drug_code", "best.confidence AS crosswalk_confidence"
        )
    return crosswalk.groupBy("compound_id").agg(
        F.expr("max(drug_code) AS drug_code"), F.expr("max(confidence) AS crosswalk_confidence")
    )


def adverse_by_drug(observations: DataFrame) -> DataFrame:
    """Adverse observations and their distinct terms per drug code.

    Terms are counted per (drug, term) first: what is collected per drug is its
    distinct terms only, however many rows one drug has.
    """
    per_term = (
        observations.where(f"observation_type = '{V.ADVERSE}'")
        .groupBy("drug_code", "value").agg(F.expr("count(1) AS n"))
    )
    return per_term.groupBy("drug_code").agg(
        F.expr("sum(n) AS n_adverse"), F.expr("collect_list(value) AS terms")
    )


def adverse_by_compound(
    crosswalk: DataFrame, observations: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """Adverse count and sorted distinct terms over all drug codes of a compound.

    Observations are aggregated before the join, so a drug code shared by many
    compounds multiplies one row, not its observations.
    """
    mapped = (
        crosswalk.where("drug_code IS NOT NULL")
        .groupBy("compound_id", "drug_code").agg(F.expr("count(1) AS times"))
    )
    joined = join_unique(
        mapped, adverse_by_drug(observations), ["drug_code"], "inner",
        spread=["compound_id"], hot_rows=hot_rows,
    )
    terms = "array_sort(array_distinct(flatten(collect_list(terms))))"
    return joined.groupBy("compound_id").agg(
        F.expr("sum(n_adverse * times) AS n_adverse"),
        F.expr(f"array_join({terms}, ', ') AS terms"),
    )


def flagged_compounds(flags: DataFrame) -> DataFrame:
    return flags.where("is_flagged").select("compound_id").distinct()


def signals(
    compounds: DataFrame, crosswalk: DataFrame, observations: DataFrame, as_of: datetime,
    coherent: bool = False, hot_rows: int | None = None,
) -> DataFrame:
    """Three-state signal for each given compound (one row per compound)."""
    mapping = collapse_crosswalk(crosswalk, coherent)
    adverse = adverse_by_compound(crosswalk, observations, hot_rows)
    joined = compounds.join(mapping, "compound_id", "left").join(adverse, "compound_id", "left")
    return joined.selectExpr(
        "compound_id",
        f"{decide.signal_state('drug_code', 'n_adverse')} AS correlation_state",
        "drug_code",
        "crosswalk_confidence",
        "coalesce(n_adverse, 0L) AS n_adverse_obs",
        f"{decide.signal_detail('drug_code', 'n_adverse', 'terms')} AS signal_detail",
        f"{stamp(as_of)} AS evaluated_ts",
    )


def correlate(
    flags: DataFrame, crosswalk: DataFrame, observations: DataFrame, as_of: datetime,
    coherent: bool = False, hot_rows: int | None = None,
) -> DataFrame:
    """Three-state signal per flagged compound."""
    return signals(flagged_compounds(flags), crosswalk, observations, as_of, coherent, hot_rows)


def public_summary(correlation: DataFrame) -> DataFrame:
    """Compound-level view without drug code, terms or patient data."""
    return correlation.selectExpr(
        "compound_id", "correlation_state", "n_adverse_obs",
        f"{decide.signal_summary('correlation_state')} AS signal_summary",
    )


def state_counts(correlation: DataFrame) -> DataFrame:
    return correlation.groupBy("correlation_state").agg(F.expr("count(1) AS n_compounds"))
