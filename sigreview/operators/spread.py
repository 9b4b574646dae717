"""Joins and orderings that hold when a few keys carry most of the rows.

``join_unique`` joins to a side with one row per key and cuts heavy keys of the
other side into slices.  ``running_total`` numbers or accumulates rows in a
total order through Spark's range sort, so no group has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin

# A key with at least this many rows is cut into slices of about this size.
# There can be at most (all rows / HOT_ROWS) such keys, which bounds the
# broadcast list of them: 200,000 short rows for 10^12 input rows.
HOT_ROWS = 5_000_000

# Rows whose key is null match nothing; they are spread over this many slices.
NULL_SLICES = 4096

# Dimension tables up to this many rows are broadcast.
DIMENSION_ROWS = 50_000

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row index in 33 bits


def join_unique(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    spread: Sequence[str],
    weights: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Equi-join ``left`` to ``right``, which has at most one row per key.

    ``how`` is one of left, inner, left_semi, left_anti; for these Spark itself splits a
    skewed left side at run time, and that is left to it.  Where the number of left
    rows per key is known (``weights``, column ``rows``), or ``hot_rows`` is given and it
    is counted, heavy keys are cut into slices before the join.  ``spread`` names
    columns of ``left`` that differ within a key.
    """
    on = list(on)
    if weights is None and hot_rows is None:
        return left.join(right, on, how)
    hot_rows = hot_rows or HOT_ROWS
    if weights is None:
        weights = left.groupBy(*on).agg(F.expr("count(1) AS rows"))
    hot = F.broadcast(weights.where(f"rows >= {hot_rows}").selectExpr(
        *on, f"CAST(ceil(rows / {hot_rows}) AS INT) AS _slices"))
    digest = f"xxhash64({', '.join(spread)})"
    any_null = " OR ".join(f"{key} IS NULL" for key in on)
    left_slice = (
        f"CAST(CASE WHEN {any_null} THEN pmod({digest}, {NULL_SLICES}) "
        f"WHEN _slices > 1 THEN pmod({digest}, _slices) ELSE 0 END AS INT) AS _slice"
    )
    sliced_left = left.join(hot, on, "left").selectExpr(*left.columns, left_slice)
    sliced_right = right.join(hot, on, "left").selectExpr(
        *right.columns, "explode(sequence(0, coalesce(_slices, 1) - 1)) AS _slice")
    return sliced_left.join(sliced_right, [*on, "_slice"], how).drop("_slice")


def join_dimension(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    spread: Sequence[str],
    max_rows: int = DIMENSION_ROWS,
) -> DataFrame:
    """Join to a dimension with one row per key.

    Its size is checked first: up to ``max_rows`` it is broadcast, beyond that
    the join shuffles with heavy keys sliced.
    """
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), list(on), how)
    return join_unique(left, right, on, how, spread=spread)


def running_total(
    df: DataFrame,
    order: Sequence[str],
    *,
    group: Sequence[str] = (),
    weight: str | None = None,
    total: str = "running",
    group_total: str | None = None,
) -> DataFrame:
    """Add the inclusive running sum of ``weight`` (default 1) per group.

    ``order`` holds SQL sort terms such as ``"margin ASC NULLS LAST"``; the
    ``group`` columns followed by them must be a total order.  The rows are
    range-sorted and pinned once; then only one sum per (sort partition, group)
    is needed to carry totals across partitions.
    """
    columns, group = df.columns, list(group)
    terms = [_sort_term(t) for t in [*group, *order]]
    pinned = pin(
        df.selectExpr("*", f"CAST({weight or '1'} AS BIGINT) AS _rt_weight")
        .orderBy(*terms)
        .selectExpr("*", "monotonically_increasing_id() AS _rt_slot")
    )
    # Group keys that also join where a group is null.
    keys = {f"_rt_g{i}": f"coalesce(CAST({g} AS STRING), '')" for i, g in enumerate(group)}
    keys |= {f"_rt_n{i}": f"{g} IS NULL" for i, g in enumerate(group)}
    part = {"_rt_part": f"shiftright(_rt_slot, {_SLOT_BITS})"} | keys
    keyed = pinned.selectExpr("*", *[f"{sql} AS {name}" for name, sql in part.items()])

    # One row per sort partition and group: a window over one group sees at
    # most as many rows as there are sort partitions.
    runs = keyed.groupBy(*part).agg(
        F.expr("sum(_rt_weight) AS _rt_sum"), F.expr("min(_rt_slot) AS _rt_first"))
    of_group = f"PARTITION BY {', '.join(keys)}" if keys else ""
    before = f"{of_group} ORDER BY _rt_part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    carried = runs.selectExpr(
        *part, "_rt_first",
        f"coalesce(sum(_rt_sum) OVER ({before}), 0) AS _rt_before",
        f"sum(_rt_sum) OVER ({of_group}) AS _rt_total",
    )
    if not group:
        carried = F.broadcast(carried)  # one row per sort partition
    joined = keyed.join(carried, list(part), "inner")
    own = "_rt_slot - _rt_first + 1"
    if weight:
        local = f"PARTITION BY {', '.join(part)} ORDER BY _rt_slot"
        own = f"sum(_rt_weight) OVER ({local} ROWS UNBOUNDED PRECEDING)"
    out = [*columns, f"CAST(_rt_before + {own} AS BIGINT) AS {total}"]
    if group_total:
        out.append(f"CAST(_rt_total AS BIGINT) AS {group_total}")
    return joined.selectExpr(*out)


def _sort_term(term: str):
    """``name``, ``name DESC`` or ``expression ASC NULLS LAST`` as a sort column."""
    words = term.split()
    nulls = None
    if words[-2:-1] == ["NULLS"]:
        nulls, words = words[-1], words[:-2]
    down = words[-1] == "DESC"
    column = F.expr(" ".join(words[:-1] if words[-1] in ("ASC", "DESC") else words))
    if down:
        return column.desc_nulls_first() if nulls == "FIRST" else column.desc()
    return column.asc_nulls_last() if nulls == "LAST" else column.asc()


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    *,
    group: Sequence[str] = (),
    name: str = "position",
    group_size: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """1-based position of every row in a total order, per group.

    Groups are first counted: if none has ``hot_rows`` rows a window numbers them, with one
    shuffle and nothing written; else, and without groups, all go through ``running_total``.
    """
    group = list(group)
    if group and df.groupBy(*group).count().where(f"count >= {hot_rows}").isEmpty():
        rows = Window.partitionBy(*group)
        numbered = df.withColumn(name, F.row_number().over(rows.orderBy(*[_sort_term(t) for t in order])).cast("bigint"))
        return numbered.withColumn(group_size, F.count(F.lit(1)).over(rows)) if group_size else numbered
    return running_total(df, order, group=group, total=name, group_total=group_size)


def exact_percentiles(
    df: DataFrame,
    value: str,
    points: dict[str, float],
    *,
    group: Sequence[str] = (),
) -> DataFrame:
    """Continuous percentiles of ``value`` per group, interpolated, nulls skipped.

    Equal values are counted first, then ranked through ``running_total``, so a
    group of any size is spread over the sort partitions.
    """
    group = list(group)
    counts = df.where(f"{value} IS NOT NULL").groupBy(*group, value).agg(F.expr("count(1) AS _rows"))
    ranked = running_total(
        counts, [value], group=group, weight="_rows", total="_upto", group_total="_all")
    aggs, out = ["max(_all) AS _all"], []
    for name, point in points.items():
        rank = f"({float(point)!r}D * (_all - 1))"
        for end, at in (("lo", f"floor({rank})"), ("hi", f"ceil({rank})")):
            holds = f"{at} >= _upto - _rows AND {at} < _upto"
            aggs.append(f"max(CASE WHEN {holds} THEN {value} END) AS _{end}_{name}")
        out.append(
            f"CAST(_lo_{name} + (_hi_{name} - _lo_{name}) * ({rank} - floor({rank})) AS DOUBLE) AS {name}")
    picked = ranked.groupBy(*group).agg(*[F.expr(a) for a in aggs])
    return picked.selectExpr(*group, *out)
