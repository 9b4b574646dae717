"""SQL expressions that turn vendor text into typed values; bad text gives NULL."""

from __future__ import annotations

from .. import fixed_values as V
from .text import raw


def _part(sample: str, index: int) -> str:
    return f"nullif(regexp_extract({sample}, {raw(V.SAMPLE_ID_PATTERN)}, {index}), '')"


def sample_compound(sample: str) -> str:
    return _part(sample, 1)


def sample_plate(sample: str) -> str:
    return f"concat('P', {_part(sample, 2)})"


def sample_well(sample: str) -> str:
    return _part(sample, 3)


def sample_replicate(sample: str) -> str:
    return f"TRY_CAST({_part(sample, 4)} AS INT)"


def sample_group(sample: str) -> str:
    """Compound number of any id with the compound prefix, well-formed or not."""
    return f"nullif(regexp_extract({sample}, {raw(V.SAMPLE_GROUP_PATTERN)}, 1), '')"


def vendor_timestamp(text: str) -> str:
    """Vendor timestamp text to a wall-clock timestamp, cut to milliseconds."""
    shape = raw(V.VENDOR_TS_PATTERN)
    iso = f"regexp_replace({text}, {shape}, '$1-$2-$3 $4:$5:$6.$7')"
    return f"TRY_CAST(CASE WHEN {text} RLIKE {shape} THEN {iso} END AS TIMESTAMP_NTZ)"


def vendor_timestamp_text(ts: str) -> str:
    """The inverse of :func:`vendor_timestamp`."""
    return f"date_format({ts}, '{V.VENDOR_TS_FORMAT}')"


def iso_timestamp(text: str) -> str:
    return f"TRY_CAST({text} AS TIMESTAMP_NTZ)"


def lenient_number(text: str) -> str:
    return f"TRY_CAST(CASE WHEN {text} RLIKE {raw(V.NUMBER_PATTERN)} THEN {text} END AS DOUBLE)"
