"""De-identification of observations and access policies as projections and filters."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import privacy

KEPT = ("drug_code", "observation_type", "value", "effective_ts")
REQUIRED = ("drug_code", "observation_type", "effective_ts")


def deidentify(
    observations: DataFrame,
    *,
    salt: str,
    key: str = "patient_ref",
    keep: Sequence[str] = KEPT,
    required: Sequence[str] = REQUIRED,
) -> DataFrame:
    """Salted pseudonym plus the allow-listed columns; rows without the required ones go."""
    return observations.dropna(subset=list(required)).selectExpr(
        f"{privacy.pseudonym(key, salt)} AS patient_pseudonym", *keep
    )


def dropped_rows(observations: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """How many rows :func:`deidentify` leaves out, out of how many."""
    missing = " OR ".join(f"{name} IS NULL" for name in required)
    return observations.agg(
        F.expr("count(1) AS source_rows"), F.expr(f"count_if({missing}) AS dropped_rows")
    )


@dataclass(frozen=True)
class MaskPolicy:
    """Who sees clear text, and which columns are masked for all others."""

    group: str = V.CLINICAL_GROUP
    value_columns: tuple[str, ...] = ("value",)
    key_columns: tuple[str, ...] = ("patient_pseudonym",)
    type_column: str = "observation_type"


def govern(
    df: DataFrame, policy: MaskPolicy = MaskPolicy(), *, groups: Collection[str] = ()
) -> DataFrame:
    """The rows and values a caller who is in ``groups`` may see."""
    member = str(policy.group in set(groups)).upper()
    masked = {c: privacy.mask_value(c, member) for c in policy.value_columns}
    masked |= {c: privacy.mask_key(c, member) for c in policy.key_columns}
    return df.where(privacy.row_visible(policy.type_column, member)).selectExpr(
        *[f"{masked[c]} AS {c}" if c in masked else c for c in df.columns]
    )
