"""The decision rules as SQL expressions: threshold, reason, three-state signal."""

from __future__ import annotations

from .. import fixed_values as V
from .text import fill, quote


def breaches(value: str, direction: str, threshold: str) -> str:
    """Strictly beyond the threshold on the side of concern; never NULL."""
    return (
        f"coalesce(({direction} = '{V.LOW}' AND {value} < {threshold}) "
        f"OR ({direction} = '{V.HIGH}' AND {value} > {threshold}), FALSE)"
    )


def margin(value: str, threshold: str) -> str:
    return f"round({value} - {threshold}, 4)"


def reason(
    assay: str, value: str, unit: str, direction: str, threshold: str, threshold_unit: str,
    prior_mean: str, prior_n: str,
) -> str:
    """Why a reading was flagged or not; ``prior_mean`` is rounded by the caller."""
    facts = dict(
        assay=assay, value=value, unit=f"coalesce({unit}, '')",
        direction=f"coalesce({direction}, '')", threshold=threshold,
        threshold_unit=f"coalesce({threshold_unit}, '')", margin=margin(value, threshold),
    )
    return (
        f"CASE WHEN {threshold} IS NULL THEN {fill(V.REASON_NO_REFERENCE, assay=assay)} "
        f"WHEN {breaches(value, direction, threshold)} "
        f"THEN {fill(V.REASON_BREACH, **facts, mean=prior_mean, n=prior_n)} "
        f"ELSE {fill(V.REASON_WITHIN, **facts)} END"
    )


def signal_state(drug: str, n_adverse: str) -> str:
    return (
        f"CASE WHEN {drug} IS NULL THEN '{V.NO_MAPPING}' "
        f"WHEN coalesce({n_adverse}, 0) > 0 THEN '{V.CORRELATED}' ELSE '{V.CHECKED}' END"
    )


def signal_detail(drug: str, n_adverse: str, terms: str) -> str:
    return (
        f"CASE WHEN {drug} IS NULL THEN {quote(V.DETAIL_NO_MAPPING)} "
        f"WHEN coalesce({n_adverse}, 0) > 0 THEN {fill(V.DETAIL_CORRELATED, drug=drug, terms=terms)} "
        f"ELSE {fill(V.DETAIL_CHECKED, drug=drug)} END"
    )


def signal_summary(state: str) -> str:
    return (
        f"CASE {state} WHEN '{V.CORRELATED}' THEN {quote(V.SUMMARY_CORRELATED)} "
        f"WHEN '{V.CHECKED}' THEN {quote(V.SUMMARY_CHECKED)} ELSE {quote(V.SUMMARY_NO_MAPPING)} END"
    )


def state_rank(state: str) -> str:
    """2 correlated, 1 checked, 0 anything else: the review priority of a state."""
    return f"CASE {state} WHEN '{V.CORRELATED}' THEN 2 WHEN '{V.CHECKED}' THEN 1 ELSE 0 END"


def state_of_rank(rank: str) -> str:
    return f"CASE {rank} WHEN 2 THEN '{V.CORRELATED}' WHEN 1 THEN '{V.CHECKED}' WHEN 0 THEN '{V.NO_MAPPING}' END"
