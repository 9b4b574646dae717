"""Phrase and proximity matches of the positional index against plain versions."""

import random
import re

import pytest

from sigreview.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(pairs, items, width):
    out = {}
    for i, t in pairs:
        w = words(t)
        hit, ids = set(), set()
        for name, text in items:
            v = words(text)
            n = min(width, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s: s + n] == v[a: a + n]:
                        hit.update(range(s, s + n))
                        ids.add(name)
        out[i] = (len(w), len(hit), sorted(str(x) for x in ids if x is not None))
    return out


@pytest.mark.parametrize("seed,width", [(1, 10), (2, 4), (3, 3)])
def test_against_plain(spark, make_docs, seed, width):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["İs", "ß9", "三"]
    say = lambda n: rng.choice([" ", "  ", "-", ".\n"]).join(rng.choice(vocabulary).upper() if rng.random() < .2 else rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.randint(1, 16))) for k in range(12)] + [(20, None), (21, "..."), (22, "W1"), (3, "again w2 w3"), (None, say(5))]
    items.append(items[0])
    pairs = [(k, say(rng.randint(0, 30))) for k in range(40)]
    pairs += [(100 + k, say(6) + " " + (t or "") + ", " + say(4)) for k, (_, t) in enumerate(items)]
    pairs += [(200, None), (201, ""), (202, "!!"), (203, say(5000))]
    bench = spark.createDataFrame([(i, t, 1, "q") for i, t in items], "item_id long, text string, _item long, term string")
    rows = decontaminate.contamination(make_docs([*pairs, pairs[41]]), bench, width=width).collect()
    assert len(rows) == len(pairs) + 1
    want = plain(pairs, items, width)
    assert {r._id: (r.n_words, r.n_hit, r["items"]) for r in rows} == want
    assert any(w[1] for w in want.values()) and any(not w[1] for w in want.values())


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontaminate.contamination(make_docs([]), bench).count() == 0
    rows = decontaminate.contamination(make_docs([(1, "some words"), (2, None)]), bench.where("false")).collect()
    assert sorted((r._id, r.n_words, r.n_hit, r["items"]) for r in rows) == [(1, 2, 0, []), (2, 0, 0, [])]


def test_proximity(spark, make_docs):
    rng = random.Random(4)
    pairs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(60))) for k in range(20)]
    postings = decontaminate.build_index(make_docs(pairs))
    phrases = spark.createDataFrame([("ab", ["a", "b"])], "phrase string, words array<string>")
    got = {(r._id, frozenset((r.pos, r.other))) for r in decontaminate.proximity_hits(postings, phrases, 3).collect()}
    want = {(i, frozenset((p, q))) for i, t in pairs for p, x in enumerate(words(t)) for q, y in enumerate(words(t))
            if x == "a" and y == "b" and abs(p - q) <= 3}
    assert got == want


def test_proximity_of_whole_phrases(spark, make_docs):
    """All terms must stand in one window; a term that no text has matches nothing."""
    rng = random.Random(7)
    pairs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(25))) for k in range(12)]
    postings = decontaminate.build_index(make_docs(pairs))
    asked = {"abc": ["a", "b", "c"], "defg": ["d", "e", "f", "g", "d"], "absent": ["a", "b", "zz"], "one": ["h"]}
    phrases = spark.createDataFrame(list(asked.items()), "phrase string, words array<string>")
    got = {(r.phrase, r._id) for r in decontaminate.proximity_hits(postings, phrases, 4).collect()}
    want = {(p, i) for p, w in asked.items() for i, t in pairs for s in range(25) if set(w) <= set(words(t)[s: s + 5])}
    assert got == want and {p for p, _ in got} == {"abc", "defg", "one"}
    assert len(got) < 3 * len(pairs)
