"""Fill-in-middle against plain Python, and the chunks it is cut by."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sigreview.llm import fill_middle as fm

UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def plain(doc_id, text, percent=50, suffix_first=80):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < suffix_first:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    shared = " ".join("".join(rng.choice("abcé三🙂") for _ in range(rng.randint(1, 9))) for _ in range(600))
    fixed = ["<P>", "a <S> b", "x<M", "<P", "< P>", ">M> <", " lead", "trail \n", "\x00 \x1c\x85　 x", "三" * 5000, " " * 9000,
             "a" * 10_000 + " b", "x " * 20_000, "é" * 4097, shared, "head " + shared, shared[:900] + "\n" + shared]
    return fixed + ["".join(rng.choice("ab \n\t<>SPMé三") for _ in range(rng.randint(0, 300))) for _ in range(300)]


@pytest.mark.parametrize("percent, suffix_first", [(50, 80), (100, 0), (100, 100)])
def test_outputs(make_docs, awkward, texts, percent, suffix_first):
    pairs = awkward + [(1000 + k, t) for k, t in enumerate(texts)]
    docs = make_docs(pairs).withColumn("fill_middle", F.lit(1))
    rows = fm.fill_in_middle(docs, percent=percent, suffix_first=suffix_first).withColumn(
        "back", fm.restored(F.col("fill_middle.output"), F.col("fill_middle.form"))).collect()
    assert len(rows) == len(pairs)
    key = lambda x: str(x)
    got = sorted(((r.doc_id, r.text, *r.fill_middle, r.back) for r in rows), key=key)
    assert got == sorted(((i, t, *plain(i, t, percent, suffix_first), t or "") for i, t in pairs), key=key)
    assert {r.fill_middle.form for r in rows} >= ({"plain", "spm"} if suffix_first else {"plain", "psm"})


def test_empty_table(make_docs):
    assert fm.fill_in_middle(make_docs([])).count() == 0


def test_every_cut_of_a_text(texts):
    """All units of texts whose runs begin, end and go on across chunks."""
    own = fm.Chunks(1 << 20)
    for t in [*texts[9:17], *texts[20:60]]:
        units = UNIT.findall(t)
        picks = tuple(range(len(units) + 1)) if len(units) < 700 else tuple(range(0, len(units), 997))
        n, found = own.cuts(t.encode(), picks)
        assert n == len(units)
        assert found == [len("".join(units[:k])) for k in picks]


def test_chunks(texts):
    for t in texts:
        data = t.encode()
        ends = fm.chunk_ends(data)
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert sum(sizes) == len(data) and all(s >= fm.LEAST for s in sizes[:-1]) and all(s <= fm.MOST for s in sizes)
        for a, b in zip([0, *ends], ends):
            data[a:b].decode()  # no code point is cut
    # A block border changes nothing.
    whole, fm.BLOCK = fm.BLOCK, 1000
    try:
        again = [fm.chunk_ends(t.encode()) for t in texts]
    finally:
        fm.BLOCK = whole
    assert again == [fm.chunk_ends(t.encode()) for t in texts]


def test_shared_passages_are_remembered_within_bounds(texts):
    rng = random.Random(7)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000))
    own = fm.Chunks(1 << 20)
    own.cuts(passage.encode(), (0, 0))
    missed = own.missed
    for k in range(20):
        own.cuts(f"{'x' * k} start {k}: {passage} end {k}".encode(), (1, 2))
    assert own.missed - missed < 20 * 6 and own.asked > 20 * 50
    small = fm.Chunks(2000)
    small.cuts(passage.encode(), (0, 0))
    assert small.size <= 2000 + fm.MOST
