"""Sketches within their bounds, counts taken while writing, replies that are asked once, questions from SQL."""

from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from sigreview.operators import advice, day_sketches, quality, registry, scoring
from sigreview.plans import question_functions, questions
from sigreview.schemas import READING, REPLY
from sigreview.session import names_in, pin, scratch_path

POINTS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99}


@pytest.fixture(scope="module")
def measured(spark):
    """200,000 values in 20 days: one group even, one with most of its values alike, one with a long tail."""
    rows = spark.range(0, 200_000, 1, 6).selectExpr(
        "concat('g', id % 3) AS g", "TIMESTAMP_NTZ '2026-01-01 00:00:00' + make_dt_interval(CAST(id % 20 AS INT), 3) AS ts",
        "pmod(xxhash64(id), 1000003) AS u", "CAST(pmod(xxhash64(id, 1), 40000) AS STRING) AS who")
    return pin(rows.selectExpr("g", "ts", "who", """CASE g WHEN 'g0' THEN u / 1000003D WHEN 'g1' THEN CASE WHEN u % 10 < 7 THEN 5D ELSE u * 1D END
        ELSE power(u + 1D, 3) END AS x"""))


def test_quantiles_of_any_window_are_within_the_bound(spark, measured):
    sketches = pin(day_sketches.day_sketches(measured, "ts", "x", ["who"], ["g"]))
    assert sketches.count() == 60
    for last, days in ((date(2026, 1, 20), 20), (date(2026, 1, 15), 7), (date(2026, 1, 3), 1)):
        told = {r.g: r for r in day_sketches.answers(day_sketches.window(sketches, last, days), POINTS, ["g"]).collect()}
        within = measured.where(f"CAST(ts AS DATE) > DATE '{last}' - {days} AND CAST(ts AS DATE) <= DATE '{last}'")
        for g, r in told.items():
            x = within.where(F.col("g") == g).toPandas()
            assert r.n_rows == r.n_values == len(x)
            for name, p in POINTS.items():
                below, upto = (x.x < r[name]).mean(), (x.x <= r[name]).mean()
                assert below - 2 * day_sketches.rank_error() <= p <= upto + 2 * day_sketches.rank_error(), (g, name)
            assert abs(r.n_who - x.who.nunique()) <= 4 * day_sketches.distinct_error() * x.who.nunique()
    plan = day_sketches.answers(day_sketches.window(sketches, date(2026, 1, 15), 7), POINTS, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert measured.pinned_at not in plan and sketches.pinned_at.rsplit("/", 1)[1][:20] in plan


def test_days_in_batches_and_odd_values(spark):
    day = datetime(2026, 1, 1)
    rows = [("a", day + timedelta(hours=h), x, w) for h, x, w in (
        (1, 1.0, "p"), (2, None, "p"), (3, float("nan"), None), (26, 9.0, "q"), (27, 9.0, "q"))] + [("b", day, None, "r"), ("c", None, 1.0, "s")]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, x double, who string")
    whole = day_sketches.day_sketches(df, "ts", "x", ["who"], ["g"])
    lots = day_sketches.day_sketches(df.where("hour(ts) < 2"), "ts", "x", ["who"], ["g"]).unionByName(
        day_sketches.day_sketches(df.where("hour(ts) >= 2"), "ts", "x", ["who"], ["g"]))
    for sketches in (whole, day_sketches.merged(lots, ["g", "day"])):
        got = {r.g: r for r in day_sketches.answers(sketches, {"least": 0.0, "most": 1.0}, ["g"]).collect()}
        assert (got["a"].n_rows, got["a"].n_values, got["a"].least, got["a"].most, got["a"].n_who) == (5, 3, 1.0, 9.0, 2)
        assert (got["b"].n_rows, got["b"].n_values, got["b"].least, got["b"].n_who) == (1, 0, None, 1) and "c" not in got
    assert day_sketches.answers(whole.where("false"), {"p": 0.5}, ["g"]).count() == 0


def test_the_gate_counts_what_it_writes(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    given = fx.readings(spark).withColumn("result_value", F.expr("CASE replicate % 5 WHEN 0 THEN NULL WHEN 1 THEN -1D ELSE result_value END"))
    valid, bad, counts = quality.write_split(given.repartition(3).mapInPandas(count, READING), scratch_path(spark, "t-gate"))
    assert seen.value == given.count()  # each row was made once, for rows and counts together
    want_valid, want_bad = quality.split_quality(given)
    assert valid.exceptAll(want_valid).count() == want_valid.exceptAll(valid).count() == 0 and valid.columns == given.columns
    assert bad.exceptAll(want_bad).count() == want_bad.exceptAll(bad).count() == 0
    assert counts.collect() == quality.reconcile(given).collect()
    empty = quality.write_split(given.where("false"), scratch_path(spark, "t-gate"))
    assert [df.count() for df in empty[:2]] == [0, 0] and tuple(empty[2].first()) == (0, 0, 0, True)


def prompts(spark, *rows):
    return spark.createDataFrame(rows, "compound_id string, recommendation_input string, model_endpoint string")


def test_replies_are_asked_once(spark):
    folder, asked = scratch_path(spark, "t-replies"), spark.sparkContext.accumulator(0)

    def model(texts: pd.Series) -> pd.Series:
        asked.add(len(texts))
        return ("reply to " + texts).where(~texts.str.contains("silent"))

    def run(*rows):
        before = asked.value
        found = advice.recommend_kept(prompts(spark, *rows), model, folder).collect()
        return {(r.compound_id, r.model_endpoint): r.recommendation for r in found}, asked.value - before
    first = (("a", "x", "m"), ("b", "x", "m"), ("c", "y", "m"), ("d", None, "m"), ("e", "silent", "m"))
    told, calls = run(*first)
    assert calls == 3  # equal prompts once, a NULL prompt never
    assert told == {("a", "m"): "reply to x", ("b", "m"): "reply to x", ("c", "m"): "reply to y", ("d", "m"): None, ("e", "m"): None}
    assert run(*first) == (told, 0)
    # A changed prompt and another model are new; the old ones are still known.
    told, calls = run(("a", "x", "m"), ("a", "x", "other"), ("c", "y2", "m"))
    assert calls == 2 and told == {("a", "m"): "reply to x", ("a", "other"): "reply to x", ("c", "m"): "reply to y2"}
    assert advice.kept_replies(spark, folder).count() == 5
    assert run() == ({}, 0)


def test_a_failed_run_keeps_no_reply(spark):
    folder = scratch_path(spark, "t-replies")

    def broken(texts: pd.Series) -> pd.Series:
        raise RuntimeError("no model")
    with pytest.raises(Exception, match="no model"):
        advice.recommend_kept(prompts(spark, ("a", "x", "m")), broken, folder)
    assert not [n for n in names_in(spark, folder) if n.endswith(".parquet")] and advice.kept_replies(spark, folder).count() == 0
    assert advice.recommend_kept(prompts(spark, ("a", "x", "m")), lambda t: t, folder).first().recommendation == "x"
    # A reply that was written twice, as by two runs side by side, still is one.
    spark.createDataFrame([(r.prompt_hash, "m", "late") for r in advice.kept_replies(spark, folder).collect()], REPLY).write.mode("append").parquet(folder)
    assert advice.recommend_kept(prompts(spark, ("a", "x", "m")), broken, folder).count() == 1


def test_questions_from_sql(spark):
    readings, reference = fx.readings(spark), fx.reference(spark)
    flags = pin(scoring.score_readings(readings, reference, fx.AS_OF))
    summary = spark.createDataFrame([("CMPD00012", "correlated", "s"), ("CMPD00003", "no_mapping", "t")],
                                    "compound_id string, correlation_state string, signal_summary string")
    known = registry.compound_registry(readings)
    names = question_functions.register_questions(spark, readings, flags, reference, known, summary, "t_")
    assert len(names) == 11

    def same(sql, df):
        got = spark.sql(sql)
        assert got.columns == df.columns and got.exceptAll(df).count() == df.exceptAll(got).count() == 0 and got.count() > 0
    same("SELECT * FROM t_currently_flagged()", questions.currently_flagged(flags))
    same("SELECT * FROM t_against_threshold()", questions.against_threshold(readings, reference))
    same("SELECT * FROM t_most_flagged_assay()", questions.most_flagged_assay(flags))
    same("SELECT * FROM t_registry_size()", questions.registry_size(known))
    same("SELECT * FROM t_concern_thresholds()", questions.concern_thresholds(reference))
    same("SELECT * FROM t_correlated_compounds()", questions.correlated_compounds(summary))
    same("SELECT * FROM t_compounds_per_state()", questions.compounds_per_state(summary))
    same("SELECT * FROM t_unmapped_compounds()", questions.unmapped_compounds(summary))
    same("SELECT * FROM t_last_readings()", questions.last_readings(readings))
    same("SELECT * FROM t_last_readings(n => 1)", questions.last_readings(readings, n=1))
    same("SELECT * FROM t_last_readings('CMPD00012', 2)", questions.last_readings(readings, "CMPD00012", 2))
    same("SELECT * FROM t_flagged_in_assay('hERG_IC50')", questions.flagged_in_assay(flags, "hERG_IC50"))
    same("SELECT * FROM t_flagged_in_assay('hERG_IC50', below => 0.5)", questions.flagged_in_assay(flags, "hERG_IC50", 0.5))
    same("SELECT * FROM t_average_per_compound('hERG_IC50')", questions.average_per_compound(readings, "hERG_IC50"))
    # For each row of another table.
    summary.createOrReplaceTempView("t_summary")
    got = spark.sql("SELECT s.compound_id, count(1) AS n FROM t_summary s, LATERAL t_last_readings(s.compound_id, 2) r GROUP BY 1")
    want = {c: min(2, readings.where(F.col("compound_id") == c).count()) for c in ("CMPD00012", "CMPD00003")}
    assert {r.compound_id: r.n for r in got.collect()} == want
