"""Small helpers shared by the text operators: row keys, checked joins, ASCII rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin, scratch_path, unpin  # noqa: F401  (re-used by the operators)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A side with at most this many rows may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000

#: Characters that count as white space in the contracts: space and \t to \r.
BLANKS = " \t\n\x0b\f\r"


def lower_ascii(text: str) -> str:
    """SQL that lower-cases A-Z only; text of ASCII characters takes the faster way."""
    return (f"CASE WHEN octet_length({text}) = char_length({text}) THEN lower({text}) "
            f"ELSE translate({text}, '{UPPER}', '{LOWER}') END")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns ``_id``, ``_th`` and ``_text`` (null text as empty).

    ``_id`` and ``_th``, the hash of the text, name a row: rows that agree in both are
    repeats of one row and get the same results.  ``_id`` may be null.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: str = "1") -> bool:
    """Whether df, a written table, has at most so many rows, and at most ten times as much ``weight``."""
    if weight == "1":
        return df.limit(rows + 1).count() <= rows
    n, total = df.selectExpr("count(1)", f"sum({weight})").first()
    return n <= rows and (total or 0) <= 10 * rows


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str,
                 rows: int = BROADCAST_ROWS, weight: str = "1") -> DataFrame:
    """Null-safe equi-join; ``right``, a written table, is broadcast only if it is small.

    Otherwise both sides shuffle, and Spark splits skewed partitions at run time.
    The result has the columns of ``left`` and those of ``right`` beside ``on``.
    """
    if is_small(right, rows, weight):
        right = F.broadcast(right)
    return join_same(left, right, on, how)


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null equals null."""
    renamed = right.select(*[
        F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    terms: Column | None = None
    for c in on:
        term = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        terms = term if terms is None else terms & term
    joined = left.join(renamed, terms, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{c}" for c in on])


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which follows the input's size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
