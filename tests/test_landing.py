"""Landed lines that can't be read are kept with a reason, and published names change in one step."""

import json

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from sigreview.plans.catalog import ORACLES
from sigreview.session import names_in, scratch_path
from sigreview.sources import envelope, lines, resultset, tables

BAD = [
    ("", "blank_line"), ("   ", "blank_line"),
    ("not json", "unreadable_json"), ('{"LIMS_EXPORT": {"resultSet"', "unreadable_json"), ('"text"', "unreadable_json"), ("7", "unreadable_json"),
    ('{"LIMS_EXPORT": {"resultSet": {"totalCount": "many", "records": []}}}', "unreadable_json"),
    ('{"LIMS_EXPORT": {"resultSet": {"records": {"smpl": "a"}}}}', "unreadable_json"),
    ("{}", "no_envelope"), ('{"error": "busy"}', "no_envelope"), ('{"LIMS_EXPORT": null}', "no_envelope"),
    ('{"LIMS_EXPORT": {}}', "no_records"), ('{"LIMS_EXPORT": {"resultSet": {"offset": 0}}}', "no_records"),
    ('{"LIMS_EXPORT": {"resultSet": {"records": null}}}', "no_records"),
]
FINE = '{"LIMS_EXPORT": {"resultSet": {"offset": 0, "records": []}, "more": [1, 2]}, "other": 1}'


def bodies(spark):
    """Three pages, the bad lines and an empty page, all mixed."""
    pages = envelope.write_envelopes(fx.readings(spark), page_size=8).select("body")
    return pages.unionByName(spark.createDataFrame([*[(b,) for b, _ in BAD], (FINE,)], "body string")).repartition(3)


def test_every_line_is_a_page_or_a_reject(spark):
    raw = bodies(spark)
    rejects = envelope.rejected_pages(raw).collect()
    assert sorted((r.body, r.reject_reason) for r in rejects) == sorted(BAD)
    pages = envelope.parse_pages(raw)
    assert pages.count() + len(rejects) == raw.count()
    assert envelope.ingest_readings(pages).exceptAll(fx.readings(spark)).count() == 0
    counts = {r.outcome: r.n_lines for r in lines.outcome_counts(lines.parse_lines(raw, envelope.PAGE_LINE)).collect()}
    assert sum(counts.values()) == raw.count() and counts["good"] == pages.count() and counts["no_records"] == 3
    assert envelope.rejected_pages(spark.createDataFrame([(None,)], "body string")).first().reject_reason == "blank_line"
    assert envelope.parse_pages(raw.where("false")).count() == 0


def test_landed_files_are_parsed_once(spark):
    path, folder = scratch_path(spark, "t-land"), scratch_path(spark, "t-landed")
    raw = bodies(spark)
    raw.write.text(path)
    pages, rejects = envelope.land_pages(spark, path, folder)
    assert envelope.ingest_readings(pages).count() == fx.readings(spark).count()
    got = rejects.collect()
    assert sorted((r.body, r.reject_reason) for r in got) == sorted(BAD) and all("t-land" in r.source_file for r in got)
    # Both sides read their own partitions of what was written; nothing parses again.
    for side in (pages, rejects):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(outcome" in plan and "from_json" not in plan


def test_streams_keep_rejects(spark):
    path, folder, state = (scratch_path(spark, n) for n in ("t-in", "t-out", "t-state"))
    raw = bodies(spark).collect()
    for k in range(0, len(raw), 7):
        spark.createDataFrame(raw[k:k + 7], "body string").coalesce(1).write.mode("append").text(path)
        query = lines.start_landing(lines.stream_lines(spark, path, 1), envelope.PAGE_LINE, folder, state)
        query.awaitTermination()
        assert query.exception() is None
    good, rejects = lines.landed(spark, envelope.PAGE_LINE, folder)
    assert sorted((r.body, r.reject_reason) for r in rejects.collect()) == sorted(BAD) and good.count() + len(BAD) == len(raw)


def test_result_sets(spark):
    good = json.dumps({"columns": [{"name": "a", "path": "/a"}], "rows": [["1"], ["2"]]})
    given = [good, '{"columns": [], "rows": []}', '{"rows": [["1"]]}', '{"columns": [{"name": "a"}]}', "{", ""]
    path, folder = scratch_path(spark, "t-sets"), scratch_path(spark, "t-sets-landed")
    raw = spark.createDataFrame([(g,) for g in given], "body string")
    raw.write.text(path)
    sets, rejects = resultset.land_result_sets(spark, path, folder)
    assert sorted(r.reject_reason for r in rejects.collect()) == ["blank_line", "no_columns", "no_rows", "unreadable_json"]
    assert sets.count() == 2 and [r.a for r in resultset.result_rows(sets, ["a"]).orderBy("a").collect()] == ["1", "2"]
    assert resultset.rejected_result_sets(raw).count() == 4 and resultset.read_result_sets(spark, path).count() == 2


def test_a_failed_write_leaves_what_was_published(spark):
    name, folder = "t_published", scratch_path(spark, "t-versions")
    old = spark.range(100).withColumn("x", F.lit("old"))
    tables.publish_version(old, name, folder, "first", owner="us")
    broken = spark.range(0, 100, 1, 4).selectExpr("id", "CASE WHEN id = 99 THEN raise_error('broken') ELSE 'new' END AS x")
    before = names_in(spark, folder)
    with pytest.raises(Exception, match="broken"):
        tables.publish_version(broken, name, folder, "second")
    assert names_in(spark, folder) == before
    assert spark.table(name).where("x = 'old'").count() == 100 and tables.table_notes(spark, name)["comment"] == "first"
    # A version whose write never ended, as after a crash, is no version, and goes at the next publishing.
    spark.range(3).write.parquet(f"{folder}/version=00000007-dead")
    store = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=00000007-dead/{tables.DONE}")
    store.getFileSystem(spark._jsc.hadoopConfiguration()).delete(store, False)
    assert len(tables.versions(spark, folder)) == 1
    tables.publish_version(spark.table(name).limit(10), name, folder)
    assert spark.table(name).count() == 10 and sorted(names_in(spark, folder)) == tables.versions(spark, folder)
    assert "comment" not in tables.table_notes(spark, name)


def test_readers_under_way_and_versions_kept(spark):
    name, folder = "t_versions", scratch_path(spark, "t-versions")
    seen = []
    for k in range(4):
        seen.append(tables.publish_version(spark.range(k + 1).withColumn(f"c{k}", F.lit(k)), name, folder, keep=2))
        assert spark.table(name).columns == ["id", f"c{k}"] and spark.table(name).count() == k + 1
    assert seen[2].count() == 3  # planned before the last publishing
    found = tables.versions(spark, folder)
    assert [v.split("-")[0] for v in found] == ["version=00000002", "version=00000003"]
    # What is published may be made of what it replaces.
    assert tables.publish_version(spark.table(name).union(spark.table(name)), name, folder).count() == 8
    assert tables.publish_version(spark.table(name).where("false"), name, folder).count() == 0


def test_keys():
    assert {"s1_page_rejects", "s6_landed_pages", "s6_landed_rejects", "s6_landed_counts", "s8_versioned_publish", "t1_landing_stream"} <= set(ORACLES)
