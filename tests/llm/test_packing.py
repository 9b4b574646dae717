"""Packing against the library and a best fit over single pieces."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sigreview.llm import packing, queries


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(queries.WORD_BPE)
    return lambda text: [*found.encode(text or "", add_special_tokens=False).ids, 0]


def best_fit(lengths, size):
    """The number of sequences of best fit, longest first, one piece at a time."""
    rooms, made = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        if k == len(rooms):
            rooms.append(size - n)
            made += 1
            bisect.insort(rooms, rooms.pop())
        else:
            bisect.insort(rooms, rooms.pop(k) - n)
    return made


def check(rows, pairs, library, size):
    """Every document's pieces are whole, and every sequence is filled from 0 without a gap."""
    want = Counter()
    for i, t in pairs:
        ids = library(t)
        for k, start in enumerate(range(0, len(ids), size)):
            cut = ids[start:start + size]
            want[i, k, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(held) == list(range(len(held)))
    return len(held)


def test_words_give_what_whole_texts_give(library):
    """White space of all kinds, controls, combining marks, case rules and special strings between and within words."""
    rng = random.Random(6)
    atoms = [*"abIΣσςİſßÉé1²½½٣三🙂'.,-_<|>", "'s", "'LL", "\u0301", "\u0338", "\u1100\u1161", "\u200d", "\u200b", "\x00", "\x0b", "\x0c", "\x1c", "\x1f",
             "\x85", "\xa0", "\u2003", "\u2028", "\u3000", " ", " ", " ", "\n", "\t", "\r", "<|endoftext|>", "<|startoftext|>", "ΟΔΟΣ", "don't"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", " ", "\n\n", "a" * 3000]
    for found in (packing.words_of(queries.WORD_BPE).ids(pa.array(texts)), packing._whole(pa.array(texts), queries.WORD_BPE)):
        for k, text in enumerate(texts):
            assert found[0][found[1][k]:found[1][k + 1]].tolist() == library(text)[:-1], repr(text)


def test_plain_words_in_a_row_give_what_they_give_alone(library):
    rng = random.Random(8)
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + "".join(rng.choice("!'<|>.-`~[") for _ in range(rng.randint(0, 3)))
                    for _ in range(5000)})
    own = packing.Words(queries.WORD_BPE)
    own.learn(words)
    for w, k in own.slots.items():
        assert own.flat[own.starts[k]:own.starts[k] + own.sizes[k]].tolist() == library(w)[:-1], w


def test_a_worker_forgets(monkeypatch, library):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    monkeypatch.setattr(packing, "CHUNK", 30)
    texts = [f"word{k} of many {k % 3} words" for k in range(50)] + ["", "a much longer text than thirty bytes " * 3, ""]
    batch, own, got = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"]), packing.Words(queries.WORD_BPE), []
    for part in packing.lots(batch):
        ids, borders = own.ids(part.column(1))
        got += [[*ids[a:b].tolist(), 0] for a, b in zip(borders, borders[1:])]
    assert got == [library(t) for t in texts]


def test_whole_texts(make_docs, awkward, library):
    """A vocabulary in which spaces count goes through the library as it is."""
    rows = packing.pack(make_docs(awkward), queries.BYTE_BPE, size=64, words_apart=False).collect()
    other = Tokenizer.from_file(queries.BYTE_BPE)
    check(rows, awkward, lambda t: [*other.encode(t or "", add_special_tokens=False).ids, 0], 64)


@pytest.mark.parametrize("size", [2048, 64, 7, 1])
def test_packed(make_docs, awkward, library, size):
    pairs = awkward + [(100, "word " * 2047), (101, "word " * 2048), (102, "<|endoftext|> a<|startoftext|>")]
    if size == 1:
        pairs = [p for p in pairs if len(p[1] or "") < 3000]
    rows = packing.pack(make_docs(pairs), queries.WORD_BPE, size=size).collect()
    assert check(rows, pairs, library, size) == best_fit([r.length for r in rows], size)


def test_sequences_hold_the_ids(make_docs, awkward, library):
    packed = packing.pack(make_docs(awkward), queries.WORD_BPE, size=64, with_ids=True)
    rows = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        ids = rows[r.sequence_id].ids[r.offset:r.offset + r.length]
        assert ids == r.ids and r.offset in rows[r.sequence_id].starts
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_over_pieces(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 100, 2048])
    kinds = [rng.randint(1, size) for _ in range(rng.randint(1, 60))]
    counts = {n: rng.choice([1, 2, 3, 10, 50, 400]) for n in kinds}
    slots, made = packing.plan(counts, size)
    lengths = [n for n, c in counts.items() for _ in range(c)]
    assert made == best_fit(lengths, size)
    free = defaultdict(lambda: [False] * size)
    for n, c in counts.items():
        firsts = [s[0] for s in slots[n]]
        for rank in range(c):
            first, each, sequence, offset = slots[n][bisect.bisect_right(firsts, rank) - 1]
            seq, at = sequence + (rank - first) // each, offset + (rank - first) % each * n
            assert not any(free[seq][at:at + n]) and at + n <= size
            free[seq][at:at + n] = [True] * n
    assert all(row == sorted(row, reverse=True) for row in free.values()) and len(free) == made


def test_plan_stays_small():
    """A plan's size follows the lengths, not the pieces."""
    rng = random.Random(3)
    counts = {n: rng.randrange(1, 10**9) for n in range(1, 2049)}
    slots, _ = packing.plan(counts, 2048)
    assert sum(map(len, slots.values())) < 3 * 2048 * 12
    assert packing.plan({}, 2048) == ({}, 0)


def test_a_task_of_its_own_for_each_row(make_docs, library):
    """Equal lengths spread over many tasks, some of them empty."""
    pairs = [(k, "same words here") for k in range(50)]
    rows = packing.pack(make_docs(pairs).repartition(40), queries.WORD_BPE, size=10).collect()
    assert check(rows, pairs, library, 10) == 25


def test_empty_table(make_docs):
    assert packing.pack(make_docs([]), queries.WORD_BPE).count() == 0
