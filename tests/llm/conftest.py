"""Small tables with the awkward cases: nulls, empty and long texts, repeats, clashing names."""

import random

import pytest

CLASHES = "_id long, _th long, _text string, line string, key string, term string, pos int, row string, places string, n int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def doc_rows(pairs):
    return [(i, t, "en", "s", len(t) if t is not None else None, 1, 2, "x", "y", "z", "t", 3, "r", "p", 4) for i, t in pairs]


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names clash."""
    return lambda pairs: spark.createDataFrame(doc_rows(pairs), DOCS).repartition(3)


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text) pairs: nulls, blanks, a very long text, repeats, ties, near copies."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé三ß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    line = "This License line stands in a good many of the documents here."
    pairs = [(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (5, "One  Two"), (None, "a text without an id " * 4)]
    base = say(120)
    for i in range(10, 30):
        w = base.split(" ")
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = rng.choice(words)
        pairs.append((i, " ".join(w) + "\n" + line + (" " if i % 2 else "") + "\n" + say(15)))
    pairs += [(i, say(rng.randint(1, 60)) + "\n\t" + line.upper() + "\n" + line) for i in range(30, 40)]
    pairs += [(40, say(20_000)), (41, base), (42, base), (43, base.replace(" ", "\n\n"))]
    return [*pairs, pairs[8], pairs[8], (None, None), (None, line)]
