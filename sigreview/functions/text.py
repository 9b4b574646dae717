"""Wording as SQL expressions: filled templates, percent text, task ids, prompts, replies.

All modules of this package return SQL text, so that one rule serves selectExpr,
where, F.expr and SQL functions alike.  Arguments are SQL text too: mostly
column names.
"""

from __future__ import annotations

import re
from datetime import datetime

from .. import fixed_values as V


def quote(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def raw(pattern: str) -> str:
    """A SQL literal for a regular expression, backslashes kept."""
    return f"r'{pattern}'"


def stamp(moment: datetime) -> str:
    """A SQL literal for a wall-clock time."""
    return f"TIMESTAMP_NTZ '{moment:%Y-%m-%d %H:%M:%S.%f}'"


def fill(template: str, **slots: str) -> str:
    """The template as a concatenation, its {slots} replaced by expressions."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [
        f"CAST({slots[piece]} AS STRING)" if i % 2 else quote(piece)
        for i, piece in enumerate(pieces) if piece
    ]
    return f"concat({', '.join(parts)})"


def percent(rate: str) -> str:
    """A rate as whole percent, halves to even: 0.125 gives 12%."""
    return f"concat(CAST(CAST(bround(({rate}) * 100, 0) AS BIGINT) AS STRING), '%')"


def task_id(assay: str, as_of: datetime) -> str:
    return fill(V.TASK_ID, assay=assay, day=quote(f"{as_of:%Y-%m-%d}"))


def task_action(assay: str, fp: str, n: str, rate: str, tolerance: float) -> str:
    return fill(V.TASK_ACTION, assay=assay, fp=fp, n=n, rate=percent(rate),
                tolerance=percent(f"{float(tolerance)!r}D"))


def prompt(
    compound: str, n_flags: str, reasons: str, breaches: str, state: str, n_adverse: str, detail: str
) -> str:
    """Grounded instruction for an advisory model: only facts already computed."""
    clinical = fill(" with {n} adverse observation(s): {detail}", n=n_adverse,
                    detail=f"coalesce({detail}, '')")
    return fill(
        "Advise a compound reviewer. The flags below were decided by a fixed rule; do not dispute "
        "them and add no facts. {compound} has {n} flagged reading(s). Rule output: {reasons}. "
        "Breaches: {breaches}. Clinical state: {state}{clinical}. Answer in two lines. First line "
        "'" + V.REPLY_ACTION + "' and one of [" + ", ".join(V.ADVISORY_ACTIONS) + "]. Second line "
        "'" + V.REPLY_RATIONALE + "' and one sentence based on these facts.",
        compound=compound, n=n_flags, reasons=reasons, breaches=breaches, state=state,
        clinical=f"CASE WHEN {n_adverse} IS NOT NULL THEN {clinical} ELSE '' END",
    )


_REPLY = rf"(?s)^\s*{V.REPLY_ACTION}([^\n]+?)\s*\n\s*{V.REPLY_RATIONALE}([^\n]+?)\s*$"


def reply_action(reply: str) -> str:
    """The action of a well-formed two-line reply, NULL where it is not one of the four."""
    known = ", ".join(quote(a) for a in V.ADVISORY_ACTIONS)
    action = f"regexp_extract({reply}, {raw(_REPLY)}, 1)"
    return f"CASE WHEN {action} IN ({known}) THEN {action} END"


def reply_rationale(reply: str) -> str:
    return f"nullif(regexp_extract({reply}, {raw(_REPLY)}, 2), '')"


def reply_valid(reply: str) -> str:
    return f"({reply_action(reply)}) IS NOT NULL AND ({reply_rationale(reply)}) IS NOT NULL"
