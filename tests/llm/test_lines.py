"""Line de-duplication against a plain version."""

import time

import pytest

from sigreview.llm import common, line_dedup
from sigreview.session import scratch_path

BLANKS = " \t\n\x0b\f\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(pairs, min_chars=40, min_docs=5):
    """{(id, text): (n_lines, n_dropped, kept)}"""
    holders = {}
    for i, t in {(i, t or "") for i, t in pairs}:
        for line in set(x.strip(BLANKS).translate(LOWER) for x in t.split("\n")):
            holders.setdefault(line, []).append(i)
    out = {}
    for i, t in pairs:
        kept = []
        for line in (t or "").split("\n"):
            ids = holders[line.strip(BLANKS).translate(LOWER)]
            last = max((x for x in ids if x is not None), default=None)
            if len(line.strip(BLANKS)) < min_chars or len(ids) < min_docs or i == last:
                kept.append(line)
        n = len((t or "").split("\n"))
        out[i, t] = (n, n - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_against_plain(make_docs, awkward, batches):
    docs = make_docs(awkward)
    out = line_dedup.drop_repeated_lines(docs, n_batches=batches)
    assert out.columns == [*docs.columns, "line_dedup"]
    rows = out.collect()
    want = plain(awkward)
    assert len(rows) == len(awkward) and sum(r.line_dedup.n_dropped for r in rows) > 10
    by_id = {}
    for (i, t), (n, gone, kept) in want.items():
        by_id.setdefault(i, set()).add((n, gone, kept if gone or t is not None else None))
    for r in rows:
        assert (r.line_dedup.n_lines, r.line_dedup.n_dropped, r.text) in by_id[r.doc_id]
        assert r.key == "z" and r._id == 1


def test_rows_repeated_across_files_count_once(spark, make_docs):
    """Two documents hold the line; their rows lie in eight files, whichever batches these are in."""
    line = "This line stands in two documents that are repeated in many files."
    pairs = [(1, f"{line}\none"), (2, f"{line}\ntwo"), (3, "three")]
    path = scratch_path(spark, "t-repeats")
    for _ in range(8):
        make_docs(pairs).coalesce(1).write.mode("append").parquet(path)
    docs = spark.read.parquet(path)
    assert len(docs.inputFiles()) == 8
    for least, dropped in ((3, 0), (2, 8)):
        rows = line_dedup.drop_repeated_lines(docs, min_docs=least).collect()
        assert len(rows) == 24 and sum(r.line_dedup.n_dropped for r in rows) == dropped
        assert {r.text for r in rows if r.doc_id == 2} == {f"{line}\ntwo"}


def test_a_document_is_in_one_batch(spark, make_docs, awkward):
    path = scratch_path(spark, "t-dealt")
    for _ in range(3):
        make_docs(awkward).write.mode("append").parquet(path)
    rows = common.keyed(spark.read.parquet(path), "doc_id", "text")
    _, parts = line_dedup.dealt_hashes(rows, 40, 3)
    held = [{(r._id, r._th) for r in p.select("_id", "_th").distinct().collect()} for p in parts]
    assert sum(map(len, held)) == len(set().union(*held)) > 10
    assert sum(p.count() for p in parts) == line_dedup.line_hashes(rows, 40).count()


def test_runs_hold_each_hash_once(spark, make_docs, awkward):
    store = line_dedup.LineStore(spark, buckets=3)
    news = 0
    for batch in line_dedup.batches(make_docs(awkward), ["doc_id", "text"], 5):
        news += store.add(common.keyed(batch, "doc_id", "text")).count()
    levels = [level for level, _ in store.runs]
    assert levels == sorted(levels, reverse=True) and len(set(levels)) == len(levels) == 2  # 5 = 4 + 1
    held = [tuple(r) for _, t in store.runs for r in spark.table(t).select("h1", "h2").collect()]
    assert len(held) == len(set(held)) == news == store.totals().count()
    store.clean()
    left = {t.name for t in spark.catalog.listTables() if t.name.startswith("llm_line_run_")}
    assert {t for _, t in store.runs} <= left and not left & set(store.merged)
    store.clean(everything=True)
    assert not any(t.name in {r for _, r in store.runs} for t in spark.catalog.listTables())


def test_a_batch_reads_its_own_files(spark, make_docs, awkward):
    path = scratch_path(spark, "t-docs")
    make_docs(awkward).repartition(8).write.parquet(path)
    docs = spark.read.parquet(path)
    parts = line_dedup.batches(docs, ["doc_id", "text"], 3)
    files = [{r.f for r in p.selectExpr("_metadata.file_path AS f").distinct().collect()} for p in parts]
    assert sum(map(len, files)) == len(set().union(*files)) == len(docs.inputFiles())
    read = parts[0]._jdf.queryExecution().executedPlan()
    scan = [n for n in read.toString().split("\n") if "FileScan" in n]
    assert scan and sum(p.count() for p in parts) == len(awkward)


def test_merge_and_anti_join_read_sorted_runs(spark, make_docs, awkward):
    store = line_dedup.LineStore(spark, buckets=3)
    for batch in line_dedup.batches(make_docs(awkward), ["doc_id", "text"], 2):
        store.add(common.keyed(batch, "doc_id", "text"))
    run = spark.table(store.runs[0][1])
    plan = run.join(run.hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_empty(make_docs):
    assert line_dedup.drop_repeated_lines(make_docs([])).count() == 0




def test_texts_of_very_many_lines(make_docs):
    """Every second of 200,000 lines goes in all texts but one: time in proportion to the lines."""
    line = "This line is long enough and stands in each of the documents of this test."
    text = "\n".join(f"{line} {k % 50}" if k % 2 else str(k) for k in range(200_000))
    start = time.monotonic()
    rows = {r.doc_id: r for r in line_dedup.drop_repeated_lines(make_docs([(i, text) for i in range(6)])).collect()}
    assert time.monotonic() - start < 60
    assert rows[5].text == text and rows[5].line_dedup.n_dropped == 0
    for i in range(5):
        assert (rows[i].line_dedup.n_lines, rows[i].line_dedup.n_dropped) == (200_000, 100_000)
        assert rows[i].text == "\n".join(str(k) for k in range(0, 200_000, 2))
