"""The registered queries against their SQL, and the pipeline against plain versions of its stages."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from test_contamination import plain as plain_hits
from test_lines import plain as plain_lines
from test_near_copies import plain as plain_links

import __spark_entry__ as entry
import corpus_pipeline
from check_oracles import compare, connect
from sigreview.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def test_registered():
    names = {k.split("_")[0] for k in queries.QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query(spark, key):
    got = queries.QUERIES[key](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(queries.ORACLES[key]).df()) == ""


def test_pipeline(spark):
    """Each stage again in plain Python, on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    texts = {r.doc_id: r.text for r in docs.collect() if model.score(model.matches(r.text or "")) < 0.5}
    assert len(texts) < docs.count()
    texts = {i: kept for (i, _), (_, _, kept) in plain_lines(list(texts.items())).items()}
    links = plain_links(list(texts.items()), 5, 80)
    texts = {i: t for i, t in texts.items() if not links[i][0] or links[i][1] == i}
    hits = plain_hits(list(texts.items()), bench, 10)
    texts = {i: t for i, t in texts.items() if not hits[i][1]}
    with open(queries.MULTI_RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, make_docs, awkward):
    docs = make_docs(awkward).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.where("false")):
            made = stage(spark, given, SF)
            rows = made.collect()  # awkward rows and none, to the end
            assert name == "byte_bpe" or made.columns == docs.columns, name
            assert not rows if given is not docs else 0 < len(rows) <= len(awkward), name
            if name == "byte_bpe" and rows:
                texts = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in awkward)
                assert sorted(r.decoded_sha256 for r in rows) == texts
    rows = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sum(r.doc_id is None for r in rows) == 3
