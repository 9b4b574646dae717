"""All registered queries, by section of the operator inventory."""

from . import aggregates, functions, jobs, joins, rows, sources, streams  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
