"""Sketches per group and day that answer any window of days without another scan.

A day's values are kept as a KLL quantile sketch and its keys as HyperLogLog sketches, some kilobytes
each.  Sketches merge, so a window, a month or a late batch of a day costs the sketches alone.  The exact
forms (``spread.exact_percentiles``, ``registry.registry``) stay the default; these are for answers
that are asked often and may be off by a stated bound.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accuracy of the two kinds: items that a quantile sketch keeps a level, and bits of the registers' number.
QUANTILE_K = 800
DISTINCT_BITS = 14


def rank_error(k: int = QUANTILE_K) -> float:
    """The rank of a quantile is off by no more than this share of the rows, in 99 of 100 cases."""
    return 2.296 / k**0.9021


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """The standard error of a number of distinct keys, as a share of it."""
    return 1.04 / 2 ** (bits / 2)


def day_sketches(
    df: DataFrame, ts: str, value: str, distinct: Sequence[str], group: Sequence[str] = ("assay_name",),
    k: int = QUANTILE_K, bits: int = DISTINCT_BITS,
) -> DataFrame:
    """One row per group and ``day``: n_rows, the sketch ``values`` and one sketch ``keys_<name>`` per distinct column.

    Nulls and NaN have no place in an order and are left out of ``values``; rows without a time have no day and
    are left out.  One pass; tasks send sketches, not rows, so a group that holds most rows is no matter.
    """
    ordered = f"CASE WHEN NOT isnan({value}) THEN CAST({value} AS DOUBLE) END"
    return df.where(f"{ts} IS NOT NULL").groupBy(*group, F.expr(f"CAST({ts} AS DATE)").alias("day")).agg(
        F.expr("count(1) AS n_rows"), F.expr(f"kll_sketch_agg_double({ordered}, {int(k)}) AS values"),
        *[F.expr(f"hll_sketch_agg({name}, {int(bits)}) AS keys_{name}") for name in distinct])


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches merged to one row per ``by``, which may be the group and day again (a late batch) or the group alone."""
    keys = [c for c in sketches.columns if c.startswith("keys_")]
    return sketches.groupBy(*by).agg(
        F.expr("sum(n_rows) AS n_rows"), F.expr("kll_merge_agg_double(values) AS values"),
        *[F.expr(f"hll_union_agg({c}) AS {c}") for c in keys])


def window(sketches: DataFrame, last: date, days: int) -> DataFrame:
    """The sketches of ``days`` whole days, ``last`` the newest."""
    return sketches.where(f"day > DATE '{last}' - {int(days)} AND day <= DATE '{last}'")


def answers(sketches: DataFrame, points: Mapping[str, float], by: Sequence[str] = ("assay_name",)) -> DataFrame:
    """Per ``by``: n_rows, n_values, a quantile for each of ``points`` and n_<name> for each distinct column.

    A quantile is a value of the data whose rank is within :func:`rank_error`; without values it is NULL.
    """
    whole = merged(sketches, by)
    n = "kll_sketch_get_n_double(values)"
    names = [c.removeprefix("keys_") for c in sketches.columns if c.startswith("keys_")]
    return whole.selectExpr(
        *by, "n_rows", f"{n} AS n_values",
        *[f"CASE WHEN {n} > 0 THEN kll_sketch_get_quantile_double(values, {float(p)!r}D) END AS {name}" for name, p in points.items()],
        *[f"hll_sketch_estimate(keys_{name}) AS n_{name}" for name in names])
