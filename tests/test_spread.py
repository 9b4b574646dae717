"""Joins and orderings against brute force, with heavy keys forced into slices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigreview.operators import scoring
from sigreview.operators.spread import exact_percentiles, join_dimension, join_unique, number_rows, running_total


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, some on a null key, the rest spread."""
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot", None] + [f"k{j}" for j in range(40)]) if i % 3 else "hot", rng.randint(0, 50))
            for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id bigint, key string, value int").repartition(8)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [10, 100, 10**9])
def test_join_unique(spark, skewed, how, hot_rows):
    rows, left = skewed
    known = {f"k{j}": j for j in range(30)} | {"hot": 99}
    right = spark.createDataFrame(list(known.items()), "key string, number int")
    got = join_unique(left, right, ["key"], how, spread=["id"], hot_rows=hot_rows)
    plain = left.join(right, "key", how).select(*got.columns)
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_heavy_keys_are_cut_into_slices(spark, skewed):
    """The rows of the heavy key spread over several join keys, none with most of them."""
    _, left = skewed
    weights = left.groupBy("key").agg(F.expr("count(1) AS rows"))
    right = weights.selectExpr("key", "rows AS n").where("key IS NOT NULL")
    joined = join_unique(left, right, ["key"], spread=["id"], weights=weights, hot_rows=100)
    assert joined.where("key = 'hot'").count() == left.where("key = 'hot'").count()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan and "Cartesian" not in plan


def test_join_dimension_both_ways(spark, skewed):
    _, left = skewed
    right = left.select("key").distinct().where("key IS NOT NULL").selectExpr("key", "length(key) AS n")
    small = join_dimension(left, right, ["key"], spread=["id"])
    large = join_dimension(left, right, ["key"], spread=["id"], max_rows=3)
    assert small.exceptAll(large.select(*small.columns)).count() == 0 and large.count() == small.count()


def test_number_rows_over_all_and_per_group(spark, skewed):
    rows, df = skewed
    placed = number_rows(df, ["value DESC", "id"], group_size="n").collect()
    expected = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert [r.id for r in sorted(placed, key=lambda r: r.position)] == [r[0] for r in expected]
    assert {r.n for r in placed} == {len(rows)}

    grouped = number_rows(df, ["value", "id"], group=["key"], group_size="n").collect()
    want = {}
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        want |= {r[0]: (i + 1, len(mine)) for i, r in enumerate(mine)}
    assert {r.id: (r.position, r.n) for r in grouped} == want


def test_a_group_larger_than_a_sort_partition_is_carried_over(spark):
    df = spark.range(0, 20000, numPartitions=16).selectExpr("id", "'one' AS key")
    placed = number_rows(df, ["id DESC"], group=["key"])
    assert placed.where("position <> 20000 - id").count() == 0


def test_running_total(spark, skewed):
    rows, df = skewed
    got = {r.id: r.running for r in running_total(df, ["id"], group=["key"], weight="value").collect()}
    sums, want = {}, {}
    for i, key, value in sorted(rows):
        sums[key] = sums.get(key, 0) + value
        want[i] = sums[key]
    assert got == want


def test_percentiles_match_numpy(spark, skewed):
    rows, df = skewed
    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    one = exact_percentiles(df, "value", points).first()
    everything = [r[2] for r in rows]
    for name, p in points.items():
        assert one[name] == pytest.approx(np.percentile(everything, p * 100))
    for row in exact_percentiles(df, "value", points, group=["key"]).collect():
        mine = [r[2] for r in rows if r[1] == row["key"]]
        for name, p in points.items():
            assert row[name] == pytest.approx(np.percentile(mine, p * 100))


def test_percentiles_of_nothing(spark, skewed):
    assert exact_percentiles(skewed[1].where("value > 1000"), "value", {"p": 0.5}).first()["p"] is None


def test_scoring_does_not_depend_on_slicing(spark):
    import fixtures as fx
    plain = scoring.score_readings(fx.readings(spark), fx.reference(spark), fx.AS_OF)
    sliced = scoring.score_readings(fx.readings(spark), fx.reference(spark), fx.AS_OF, hot_rows=1)
    assert plain.exceptAll(sliced).count() == 0 and sliced.count() == plain.count()


def test_mean_is_stable_and_total(spark):
    values = [0.1, 0.2, 0.3, 1e-9, 99999.999]
    a = spark.createDataFrame([(v,) for v in values], "v double").agg(F.expr(f"{scoring.stable_mean('v')} AS m"))
    b = spark.createDataFrame([(v,) for v in reversed(values)], "v double").agg(F.expr(f"{scoring.stable_mean('v')} AS m"))
    assert a.first().m == b.first().m
    odd = spark.createDataFrame([(1.0,), (float("inf"),), (None,)], "v double")
    assert odd.agg(F.expr(f"{scoring.stable_mean('v')} AS m")).first().m == float("inf")
