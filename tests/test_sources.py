"""Vendor text, pages and result sets: good input, bad input and round trips."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from sigreview.functions import parse, text
from sigreview.operators import quality, scoring
from sigreview.plans.catalog import QUERIES
from sigreview.schemas import OBSERVATION, READING
from sigreview.session import scratch_path
from sigreview.sources import coerce, envelope, resultset, tables


def one(spark, sql, value):
    return spark.createDataFrame([(value,)], "x string").selectExpr(f"{sql} AS y").first().y


@pytest.mark.parametrize("sample,expected", [
    ("LO-CMPD00001-P2-C02-R2", ("CMPD00001", "P2", "C02", 2)),
    ("LO-CMPD00042-P13-H12-R10", ("CMPD00042", "P13", "H12", 10)),
    ("LO-CMPD0001-P2-C02-R2", (None,) * 4), ("LO-CMPD00001-P2-I02-R2", (None,) * 4),
    ("xLO-CMPD00001-P2-C02-R2", (None,) * 4), ("", (None,) * 4), (None, (None,) * 4),
])
def test_composite_id(spark, sample, expected):
    parts = (parse.sample_compound, parse.sample_plate, parse.sample_well, parse.sample_replicate)
    assert tuple(one(spark, p("x"), sample) for p in parts) == expected


@pytest.mark.parametrize("raw,expected", [
    ("20260912 04:09:15.558", datetime(2026, 9, 12, 4, 9, 15, 558000)),
    ("20260912 04:09:15.5", datetime(2026, 9, 12, 4, 9, 15, 500000)),
    ("20260912 04:09:15.558999", datetime(2026, 9, 12, 4, 9, 15, 558000)),
    ("20260230 04:09:15.558", None), ("20260912 25:09:15.558", None), ("2026-09-12 04:09:15.558", None),
    ("20260912 04:09:15", None), ("", None), (None, None),
])
def test_vendor_timestamp(spark, raw, expected):
    assert one(spark, parse.vendor_timestamp("x"), raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("23.067", 23.067), (" -1e3 ", -1000.0), (".5", 0.5), ("5.", 5.0), ("1.5f", None), ("n/a", None),
    ("", None), (None, None), ("1,5", None),
])
def test_lenient_number(spark, raw, expected):
    assert one(spark, parse.lenient_number("x"), raw) == expected


def test_group_id(spark):
    assert one(spark, parse.sample_group("x"), "LO-CMPD12-anything") == "CMPD12"
    assert one(spark, parse.sample_group("x"), "bad") is None


@pytest.mark.parametrize("rate,expected", [("0.125D", "12%"), ("0.375D", "38%"), ("0.5D", "50%"), ("0D", "0%"), ("1D", "100%")])
def test_percent(spark, rate, expected):
    assert one(spark, text.percent(rate), None) == expected


@pytest.mark.parametrize("reply,action,ok", [
    ("ACTION: proceed\nRATIONALE: all within limits.", "proceed", True),
    ("ACTION: escalate for confirmatory assay\nRATIONALE: two adverse observations.\n", "escalate for confirmatory assay", True),
    ("ACTION: call the lab\nRATIONALE: why not.", None, False), ("ACTION: proceed", None, False),
    ("Sure!\nACTION: proceed\nRATIONALE: x.", None, False), (None, None, False),
])
def test_reply(spark, reply, action, ok):
    assert one(spark, text.reply_action("x"), reply) == action
    assert bool(one(spark, text.reply_valid("x"), reply)) is ok


def test_quotes_survive_in_wording(spark):
    assert one(spark, text.quote("it's a \\ test"), None) == "it's a \\ test"


def test_pages_round_trip(spark):
    sent = fx.readings(spark)
    bodies = envelope.write_envelopes(sent, page_size=7)
    index = envelope.page_index(envelope.parse_pages(bodies)).orderBy("page_offset").collect()
    n = sent.count()
    assert [r.page_offset for r in index] == list(range(0, n, 7))
    assert sum(r.n_records for r in index) == n and {r.total_count for r in index} == {n}
    assert [r.next_offset for r in index] == [*range(7, n, 7), None]
    got = envelope.ingest_readings(envelope.parse_pages(bodies))
    assert got.schema.fieldNames() == READING.fieldNames()
    assert got.exceptAll(sent).count() == 0 and got.count() == n
    assert envelope.missing_pages(envelope.parse_pages(bodies)).count() == 0
    lost = envelope.parse_pages(bodies.where("page_offset <> 7"))
    assert [r.page_offset for r in envelope.missing_pages(lost).collect()] == [7]


def test_odd_envelopes_give_nulls_not_errors(spark):
    bodies = [
        {}, {"LIMS_EXPORT": {}}, {"LIMS_EXPORT": {"resultSet": {"records": []}}},
        {"LIMS_EXPORT": {"resultSet": {"records": [
            {"smpl": "odd", "meas": {"val": "much"}, "acqTs": "never"}, {"analyte": "A"},
            {"smpl": "LO-CMPD00001-P2-C02-R2", "meas": {"val": 23.067, "uom": "uM"}, "extra": 1}]}}},
    ]
    raw = spark.createDataFrame([(json.dumps(b),) for b in bodies] + [("not json",)], "body string")
    rows = envelope.ingest_readings(envelope.parse_pages(raw)).collect()
    assert len(rows) == 3
    by_sample = {r.sample_id: r for r in rows}
    odd, bare, good = by_sample["odd"], by_sample[None], by_sample["LO-CMPD00001-P2-C02-R2"]
    assert (odd.compound_id, odd.result_value, odd.acquired_ts) == (None, None, None)
    assert bare.assay_name == "A" and bare.result_unit is None
    assert (good.compound_id, good.result_value, good.result_unit) == ("CMPD00001", 23.067, "uM")


def test_result_sets_by_page(spark):
    """Many rows to a set, the last one shorter; nulls and order survive."""
    rows = spark.createDataFrame([(i, f"p{i}", None if i % 3 else "D", "t", "v", "2026-06-04T11:00:00") for i in range(23)],
                                 "k int, patient_ref string, drug_code string, observation_type string, value string, effective_ts string")
    bodies = resultset.write_result_sets(rows, ["k"], 10).cache()
    assert sorted(r.page_offset for r in bodies.collect()) == [0, 10, 20]
    path = scratch_path(spark, "t-sets")
    for lot in ("page_offset < 10", "page_offset >= 10"):
        bodies.where(lot).select("body").write.mode("append").text(path)
    back = resultset.ingest_observations(resultset.read_result_sets(spark, path))
    assert sorted((r.patient_ref, r.drug_code) for r in back.collect()) == sorted((r.patient_ref, r.drug_code) for r in rows.collect())


def test_a_reference_may_be_empty(spark):
    none = tables.threshold_table(spark, [])
    assert none.count() == 0 and none.columns[0] == "assay_name"
    flags = scoring.score_readings(fx.readings(spark), none, fx.AS_OF)
    assert flags.where("is_flagged OR threshold IS NOT NULL").count() == 0 and flags.count() == fx.readings(spark).count()
    with pytest.raises(ValueError):
        tables.threshold_table(spark, [(str(i), "low", 1.0, "", "", True) for i in range(tables.LITERAL_ROWS + 1)])


def test_snapshot_keeps_comment_and_properties(spark):
    df = spark.range(3)
    back = tables.save_snapshot(df, "t_snapshot", "it's noted", scratch_path(spark, "t-snap"), quality="gold")
    notes = tables.table_notes(spark, "t_snapshot")
    assert back.count() == 3 and notes["comment"] == "it's noted" and notes["quality"] == "gold"


def test_ids_beyond_five_digits(spark):
    """Users from 100,000 on still give ids that the vendor's pattern takes."""
    folder = scratch_path(spark, "t-events")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50).withColumn("user_id", F.expr("user_id + 1234567"))
    events.write.parquet(f"{folder}/events.parquet")
    got = QUERIES["c1_ingest_readings"](spark, folder).where("sample_id NOT LIKE 'bad%'").collect()
    assert got and all(r.compound_id and len(r.compound_id) == 9 for r in got)


def test_object_listing(spark):
    body = json.dumps({"LIMS_EXPORT": {"objects": [{"name": "assay_results", "recordCount": 240}]}})
    rows = envelope.list_objects(spark.createDataFrame([(body,), ("{}",)], "body string")).collect()
    assert [(r.name, r.record_count) for r in rows] == [("assay_results", 240)]


def test_result_sets(spark):
    columns = [{"name": n, "path": f"/{n}"} for n in ("drug_code", "patient_ref", "effective_ts", "value")]
    sets = [
        {"columns": columns, "rows": [["D1", "p1", "2026-06-04T11:00:00", "x"], ["D2", "p2", "bad", None], ["D3", "p3"]]},
        {"columns": columns, "rows": []}, {},
    ]
    raw = spark.createDataFrame([(json.dumps(s),) for s in sets], "body string")
    rows = resultset.ingest_observations(resultset.parse_result_sets(raw)).orderBy("patient_ref").collect()
    assert [(r.patient_ref, r.drug_code, r.observation_type, r.value, r.effective_ts) for r in rows] == [
        ("p1", "D1", None, "x", datetime(2026, 6, 4, 11)), ("p2", "D2", None, None, None), ("p3", "D3", None, None, None)]


def test_cells(spark):
    raw = [('{"values":[{"string_value":"a"},{"number_value":2},{}]}',), ('["a","2",null]',)]
    rows = resultset.unwrap_cells(spark.createDataFrame(raw, "body string")).collect()
    assert [r.cells for r in rows] == [["a", "2", None], ["a", "2", None]]


def test_declared_schema(spark):
    staged = spark.createDataFrame([("D", "p", "t", "v", "2026-06-04 11:00:00")],
                                   "drug_code string, patient_ref string, observation_type string, value string, effective_ts string")
    out = coerce.to_declared(staged, OBSERVATION)
    assert out.schema.fieldNames() == OBSERVATION.fieldNames()
    assert out.first().effective_ts == datetime(2026, 6, 4, 11)


def test_quality_split_is_a_complement(spark):
    base = fx.reading_rows()[0]

    def row(**changes):
        return tuple(changes.get(f.name, v) for f, v in zip(READING.fields, base))

    rows = [
        row(), row(compound_id=None, assay_name=None), row(assay_name=None), row(acquired_ts=None),
        row(result_value=None), row(result_value=0.0), row(result_value=-1.0), row(result_value=100000.0),
        row(result_value=100000.1), row(result_value=float("nan")), row(result_value=float("inf")),
    ]
    df = spark.createDataFrame(rows, READING)
    valid, bad = quality.split_quality(df)
    assert valid.count() == 2 and bad.count() == 9
    assert [r.quarantine_reason for r in bad.collect()] == [
        "null_compound_id", "null_assay_name", "null_acquired_ts", "null_result_value",
        "nonpositive_result_value", "nonpositive_result_value", "out_of_range_high", "out_of_range_high", "out_of_range_high"]
    assert quality.reconcile(df).first().reconciled
    assert quality.reconcile_tables(df, valid, bad).first().reconciled
    assert not quality.reconcile_tables(df, valid, bad.limit(1)).first().reconciled


def test_snapshot_view_and_json(spark):
    path = scratch_path(spark, "t-snapshot")
    assert tables.save_folder(fx.readings(spark), path).count() == len(fx.reading_rows())
    b = tables.save_folder(fx.readings(spark), path)  # a second run replaces the first
    assert b.count() == len(fx.reading_rows())
    assert tables.publish_view(b, "t_view").count() == b.count()
    row = json.loads(tables.json_rows(b.limit(1)).first().json)
    assert set(row) == set(READING.fieldNames()) and "T" in row["acquired_ts"]


def test_literal_tables_are_checked(spark):
    with pytest.raises(ValueError):
        tables.threshold_table(spark, [("A", "low", 1.0, "u", "", True)] * 2)
    assert tables.threshold_table(spark).count() == 5 and tables.crosswalk_table(spark).count() == 7
