"""Pseudonyms, placeholders and masks as SQL expressions.

``is_member`` is TRUE, FALSE or an expression for the caller's membership.
"""

from __future__ import annotations

from .. import fixed_values as V
from .text import quote


def pseudonym(identifier: str, salt: str) -> str:
    return f"sha2(concat({identifier}, {quote(salt)}), 256)"


def second_pseudonym(key: str) -> str:
    return f"concat('{V.ANON_PREFIX}', substr(sha2({key}, 256), 1, {V.ANON_DIGITS}))"


def structure_placeholder(compound: str) -> str:
    return f"concat('{V.STRUCTURE_PREFIX}', upper(substr(md5({compound}), 1, {V.STRUCTURE_DIGITS})))"


def mask_value(value: str, is_member: str) -> str:
    return f"CASE WHEN {is_member} THEN {value} ELSE {quote(V.REDACTED_VALUE)} END"


def mask_key(key: str, is_member: str) -> str:
    return f"CASE WHEN {is_member} THEN {key} ELSE {second_pseudonym(key)} END"


def row_visible(observation_type: str, is_member: str) -> str:
    """Members see every row, others no laboratory rows; a NULL type stays hidden."""
    return f"({is_member} OR {observation_type} <> '{V.LAB_RESULT}')"
