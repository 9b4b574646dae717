"""Vector codes against plain integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from sigreview.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, _id int, _label string, _x int, code string"


def plain(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error) sorted, and the codebooks."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[k][p] for k in range(min(entries, len(kept)))] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(groups[e]) for col in zip(*groups[e])] if e in groups else y for e, y in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors, sums = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for (_, _, lab), err in zip(kept, errors):
        sums[lab] += err
    out = [(i, "".join(f"{e:02x}" for _, e in f), err, sums[lab]) for (i, _, lab), f, err in zip(kept, found, errors)]
    return sorted(out, key=str), books


def vectors(seed, n, dim=16, kinds=5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(kinds)]
    as_float = lambda v: [float(np.float32(x)) for x in v]
    return [(k, as_float([c + rng.gauss(0, .2) for c in rng.choice(centres)]), rng.choice([1, 1, 1, 2, None])) for k in range(n)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, "x", 8, "zz") for r in rows], SCHEMA).repartition(3)
    found, model = vc.compress(df, **options)
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error")) for r in found.collect()), key=str), model


@pytest.mark.parametrize("parts, entries, rounds, pivots", [(8, 16, 6, 4), (4, 5, 3, 1), (1, 16, 2, 16), (2, 1, 1, 1)])
def test_codes(spark, parts, entries, rounds, pivots):
    rows = vectors(parts, 150)
    some = rows[40][1]
    rows += [(200, None, 1), (201, [1.0] * 15 + [None], 1), (202, [float("nan")] * 16, 2), (203, [float("inf")] + [0.0] * 15, 2), (204, [], 1),
             (None, some, 3), (40, some, 1), (40, some, 1), (205, [-0.0001] * 16, None), (206, some, None), (-5, [30.0, -30.0] * 8, 4)]
    got, model = run(spark, rows, parts=parts, entries=entries, rounds=rounds, pivots=pivots)
    want, books = plain(rows, parts, entries, rounds)
    assert got == want
    assert model.entries.tolist() == books
    flat = [x for book in books for y in book for x in y]
    assert model.digest() == hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    assert model.decode(got[0][1]).tolist() == [x for p in range(parts) for x in books[p][int(got[0][1][2 * p:2 * p + 2], 16)]]


def test_few_and_no_vectors(spark):
    few = vectors(1, 3)
    assert run(spark, few)[0] == plain(few, 8, 16, 6)[0]
    assert run(spark, [few[0]] * 40)[0] == plain([few[0]] * 40, 8, 16, 6)[0]
    for none in ([], [(1, None, 1)], [(1, [float("nan")] * 16, 1)]):
        assert run(spark, none)[0] == []


def test_unlike_vectors_are_an_error(spark):
    rows = vectors(1, 30)
    for wrong in ([1.0] * 8, [40_000.0] * 16):
        with pytest.raises(Exception, match="components"):
            run(spark, [*rows, (99, wrong, 1)])
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, rows, parts=3)


def test_bounds_prune_and_change_nothing():
    rng = np.random.default_rng(5)
    centres = rng.integers(-9000, 9000, (16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-600, 600, (4000, 8))
    pivots = vc.chosen_pivots(centres, 4)
    entry, best, made = vc.nearest(x, vc._roots(vc._squares(x, pivots)), centres, pivots)
    all_of_them = vc._squares(x, centres)
    assert (best == all_of_them.min(axis=1)).all() and (entry == all_of_them.argmin(axis=1)).all()
    assert made < 0.3 * all_of_them.size


def test_whole_roots():
    near = np.array([k * k + d for k in (0, 1, 2, 3, 2**20, 2**26 + 1, 2**30 - 1, 2**31 - 1) for d in (-1, 0, 1) if k * k + d >= 0])
    assert vc._roots(near).tolist() == [math.isqrt(int(v)) for v in near]
