"""Both byte-level BPE operators against the libraries."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sigreview.llm import bpe, queries, token_count
from sigreview.llm.pretokens import PairTable


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    fixed = ["", "a" * 5000, "aaaa bbbb aaaaa", "<|endoftext|> hi<|endoftext|>\n", " 　\x1c\x1f \n\n x", "İſK é́ 𝔘𝔫 ½²三\x85\xa0 \u200b",
             "x" * 70 + "é" * 80, "ab" * 3000, "'s 'll I've   \t\n  \n", " ", "\n", "🙂🙂", "the " * 30_000]
    return fixed + ["".join(rng.choice("ab c\n'sé三\x1c ½²0١!~THE ") for _ in range(rng.randint(0, 200))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    with open(queries.MULTI_RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(spark, make_docs, texts, library):
    pairs = [*enumerate(texts), (1000, None), (5, texts[5]), (None, "no id")]
    ids = bpe.encode(make_docs(pairs), queries.MULTI_RANKS, public_tokenizers.PATTERN)
    rows = bpe.decode(ids, queries.MULTI_RANKS).collect()
    at_once = {r.doc_id: r for r in bpe.encode(make_docs(pairs), queries.MULTI_RANKS, public_tokenizers.PATTERN, decoded=True).collect()}
    assert len(rows) == len(pairs)
    want = dict(pairs)
    for r in rows:
        assert r.ids == library.encode_ordinary(want[r.doc_id] or "") == list(at_once[r.doc_id].ids)
        assert bytes(at_once[r.doc_id].decoded) == bytes(r.decoded)
        assert bytes(r.decoded) == (want[r.doc_id] or "").encode()


def test_trees_side_by_side_and_alone_agree(texts, library):
    own = bpe.vocabulary(queries.MULTI_RANKS, public_tokenizers.PATTERN)
    tokens = sorted({t for x in texts for t in own.split(x) if len(t.encode()) <= 64})
    for t in tokens:
        size = 1 << (len(t.encode()) - 1).bit_length()
        one = own._one(t.encode()).tolist()
        flat, counts = own._many([t.encode()] * 2, size)
        assert one == flat[counts[0]:].tolist() == library.encode_ordinary(t) or own.split(t) != [t]


def test_a_worker_forgets(monkeypatch, texts, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "CHUNK", 50)
    own = bpe.Vocabulary(queries.MULTI_RANKS, public_tokenizers.PATTERN)
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_counts(make_docs, texts):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    pairs = [*enumerate(texts), (1000, None), (5, texts[5]), (None, "no id")]
    rows = token_count.count_tokens(make_docs(pairs), queries.BYTE_BPE).collect()
    want = dict(pairs)
    assert len(rows) == len(pairs)
    for r in rows:
        text = want[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))


def test_pair_table():
    rng = random.Random(2)
    pairs = {(rng.randrange(5000), rng.randrange(5000)): (k, k + 7) for k in range(20_000)}
    table = PairTable(*(np.array(x) for x in ([a for a, _ in pairs], [b for _, b in pairs], [r for r, _ in pairs.values()],
                                               [i for _, i in pairs.values()])))
    ask = [*pairs, *((rng.randrange(5000), rng.randrange(5000)) for _ in range(20_000)), (-1, 3), (3, -1)]
    ranks, into = table.find(np.array([a for a, _ in ask]), np.array([b for _, b in ask]))
    for (a, b), rank, symbol in zip(ask, ranks, into):
        assert rank == pairs.get((a, b), (PairTable.none, 0))[0] and ((a, b) not in pairs or symbol == rank + 7)


def test_empty(make_docs):
    assert token_count.count_tokens(make_docs([]), queries.BYTE_BPE).count() == 0
    ids = bpe.encode(make_docs([]), queries.MULTI_RANKS, public_tokenizers.PATTERN)
    assert bpe.decode(ids, queries.MULTI_RANKS).count() == 0
