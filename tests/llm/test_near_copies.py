"""The Jaccard join and the components against plain versions."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sigreview import session
from sigreview.llm import components, grams, jaccard

LOWER = {i: i + 32 for i in range(65, 91)}


def sets(pairs, n):
    out = {}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        out[i] = {tuple(w[k: k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def plain(pairs, n, percent):
    s = sets(pairs, n)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(s[a] & s[b])
            if both and 100 * both >= percent * len(s[a] | s[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,percent,light,block", [(3, 90, 64, 256), (3, 90, 2, 3), (5, 80, 3, 4), (2, 60, 2, 2)])
def test_against_plain(make_docs, awkward, n, percent, light, block):
    pairs = [p for p in awkward if p[0] is not None]
    out = jaccard.link_components(make_docs(pairs), n=n, percent=percent, light=light, block=block).collect()
    want = plain(pairs, n, percent)
    assert len(out) == len(pairs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_rows_without_an_id(make_docs):
    text = "these words stand in two rows and one of them has no id at all"
    rows = jaccard.link_components(make_docs([(None, text), (7, text), (None, "only here " * 9), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles > 0, r.component_id or 0) for r in rows) == [
        (0, False, 0), (0, True, 0), (0, True, 7), (7, True, 7)]


def near(word, changed=0):
    return " ".join([f"{word}{k}" for k in range(60)] + [f"new{word}{k}" for k in range(changed)])


def test_texts_that_share_an_id(make_docs):
    """Each text under an id is compared, and links only what it resembles itself."""
    pairs = [(1, near("a")), (2, near("b")), (5, near("a", 2)), (5, near("b", 2)), (5, near("c")), (6, near("c", 1))]
    rows = jaccard.link_components(make_docs(pairs)).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (2, 2), (5, 1), (5, 2), (5, 5), (6, 5)]


def test_one_row_of_each_group_stays(spark, make_docs):
    """Also of repeated rows and of rows without an id; a clean text stays whatever else has its id."""
    a, b, c = near("a"), near("b"), near("c")
    docs = make_docs([(1, a), (1, a), (1, a), (3, near("a", 2)), (3, near("clean")), (None, a), (None, b), (None, b),
                      (None, near("b", 1)), (4, c), (4, near("c", 1)), (7, ""), (7, ""), (None, None)])
    rows = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    left = [(r.doc_id, r.text) for r in rows]
    assert left.count((1, a)) == left.count((3, near("clean"))) == 1 and left.count((7, "")) == 2
    assert sum(t in (b, near("b", 1)) for _, t in left) == sum(t in (c, near("c", 1)) for _, t in left) == 1
    assert len(left) == 7 and rows[0].asDict().keys() == set(docs.columns)


def thue_morse(size, turned=False):
    """A word of a and b that no polynomial over powers of two tells from its complement."""
    return "".join("ab"[(bin(k).count("1") + turned) % 2] for k in range(size))


@pytest.mark.parametrize("size", [8, 1024, 2048, 4096, 65_536])
def test_words_that_arithmetic_confuses(make_docs, size):
    """Texts that differ in one long word only are different, alone and in a sentence; equal ones beside them link."""
    one, two = thue_morse(size), thue_morse(size, True)
    pairs = [(1, one), (2, two), (3, one), (4, f"say {one} now"), (5, f"say {two} now"), (6, f"SAY  {two.upper()} now")]
    rows = jaccard.link_components(make_docs(pairs), n=3, percent=90).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5), (6, 5)]


def test_word_hashes():
    """Equal for equal words wherever they stand; different for words that share blocks, lengths or ends."""
    rng = random.Random(2)
    words = {"".join(rng.choice("ab\x00é") for _ in range(rng.randint(1, 40))) for _ in range(3000)} | {"a" * k for k in range(1, 100)}
    words |= {"a" * 8 + "b" * 8, "b" * 8 + "a" * 8, "\x00", "\x00" * 2, "a\x00", "z" * 16 + "y"}
    words = sorted(words)
    shuffled = words * 2
    rng.shuffle(shuffled)
    found = {}
    for texts in (pa.array(words), pa.array([" \n".join(shuffled)])):
        sets = [g for t in texts.to_pylist() for g in grams.gram_sets(pa.array([t]), 1)]
        if len(sets) > 1:
            assert all(len(s) == 1 for s in sets)
            found = {w: int(s[0]) for w, s in zip(words, sets)}
            assert len(set(found.values())) == len(words)
        else:
            assert sorted(sets[0].tolist()) == sorted(found.values())


def test_empty(make_docs):
    assert jaccard.link_components(make_docs([])).count() == 0


def test_no_pairs_of_a_large_group(spark, make_docs):
    """A group whose members are all alike but for one word gives about a link for each."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    pairs = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(300)] = f"x{i}"
        pairs.append((i, " ".join(w)))
    out = jaccard.link_components(make_docs(pairs), light=8, block=64).collect()
    assert {r.component_id for r in out} == {0}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(500, 500)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    assert found == root


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_first_columns_stand_on_disk_by_ranges(spark, make_docs, monkeypatch):
    """No statement shuffles a large part of the first columns; 18 bytes of each did when all went at once."""
    rng = random.Random(11)
    pairs = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(300))) for i in range(400)]
    pairs += [(1000 + i, t + " and more") for i, t in pairs[:40]]
    sizes = [len(t.split()) - 2 for _, t in pairs]
    firsts = sum(s - -(-80 * s // 100) + 1 for s in sizes)
    folders = list(spark._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().conf()))
    moved = []

    def files():
        return {f"{d}/{x}" for f in folders for d, _, names in os.walk(f) for x in names if re.fullmatch(r"shuffle_.*[.]data", x)}

    def pin(df):
        before = files()
        pinned = session.pin(df)
        moved.append(sum(os.path.getsize(x) for x in files() - before))
        return pinned
    monkeypatch.setattr(session, "SHUFFLES_END", "sigreview.test.shuffles_stay")
    monkeypatch.setattr(jaccard, "pin", pin)
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jaccard.link_components(make_docs(pairs), n=3, percent=80).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    assert {r.doc_id: r.component_id for r in out} == {i: i % 1000 for i, _ in pairs}
    assert 0 < max(moved[2:]) < 9 * firsts  # after the counts and the lists themselves


def test_columns_shared_by_chance_make_no_family(make_docs, monkeypatch):
    """Where the order knows no counts, texts of the same few words share first columns; only alike ones are linked."""
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(14)}" for _ in range(n)]
    pairs = [(i, " ".join(say(70))) for i in range(300)]
    pairs += [(300 + i, pairs[i][1] + " end") for i in range(0, 40, 2)]
    given, found = [], jaccard.components
    monkeypatch.setattr(jaccard, "ORDER_COLUMNS", 0)
    monkeypatch.setattr(jaccard, "components", lambda edges: given.append(edges.count()) or found(edges))
    rows = jaccard.link_components(make_docs(pairs), n=3, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain(pairs, 3, 80)
    assert given[0] <= 40  # 20 pairs are alike; thousands share a first column


def test_bitmap_of_columns_beyond_the_order(spark):
    """Columns counted twice that the order has no room for are marked; those counted once come first."""
    rng = np.random.default_rng(1)
    names = np.unique(rng.integers(0, 1 << 32, 40_000, dtype=np.uint64))
    counts = session.pin(spark.createDataFrame([(int(c), 9 if k < 50 else 2) for k, c in enumerate(names)], "col long, n long"))
    cols, times, seen, wide = jaccard._column_order(counts, 32, 100, 1 << 27)
    assert cols.tolist() == names[:50].tolist() and set(times.tolist()) == {9}
    bits = np.unpackbits(seen, bitorder="little")
    assert len(bits) == 1 << wide and set(np.flatnonzero(bits).tolist()) == set((names >> np.uint64(32 - wide)).tolist())
    # A bitmap without room for all of them marks the most frequent ones.
    *_, seen, wide = jaccard._column_order(counts, 32, 10, 1 << 16)
    assert np.unpackbits(seen).sum() == len(set((names[:50] >> np.uint64(32 - wide)).tolist()))
    assert jaccard._column_order(counts, 32, 50_000, 1 << 27)[3] == 0


@pytest.mark.parametrize("bits", [64, 12])
def test_spreads_never_rule_out_too_much(bits):
    """Sets differ in as many columns as their spreads at least, sets of all sizes and with all their hashes in one range."""
    rng = np.random.default_rng(bits)
    of = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(64 - bits))
    whole = [of(n) for n in (1, 7, 40, 300, 300, 2000, 9000)]
    whole += [np.unique(np.append(a[: len(a) - len(a) // 9], of(k))) for a in whole for k in (1, 30)]
    for a in whole:
        for b in whole:
            assert jaccard._apart(jaccard._spread(a), jaccard._spread(b)) <= len(np.setxor1d(a, b))
