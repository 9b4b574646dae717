"""Word n-gram hashes of whole Arrow batches, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  # bytes hashed at once; a longer text is a chunk of its own

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FILLED = np.array([(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)  # the first 1 to 8 bytes of a block


def _word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each text (one more at the end).

    A word is its blocks of eight bytes, the last one filled up with zeros, and its length.  Each block is scrambled
    together with its place in the word before they are added, so no arithmetic relation between words makes them equal:
    different words agree with a chance of 2^-64, whatever they are made of.
    """
    n = len(buf)
    blank = np.empty(n + 1, bool)
    blank[:n] = _BLANK[buf]
    blank[n] = True
    edge = np.ones(n + 1, bool)  # True where the character before is blank or in another text
    edge[1:] = blank[:n]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:n] & ~blank[:n])
    after = blank.copy()
    after[offsets[1:]] = True
    ends_all = np.flatnonzero(after)
    ends = ends_all[np.searchsorted(ends_all, starts, side="right")]
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    many = (ends - starts + 7) // 8
    begin = np.cumsum(many) - many
    place = np.arange(begin[-1] + many[-1]) - np.repeat(begin, many)
    at = np.repeat(starts, many) + 8 * place
    padded = np.concatenate([_LOWER[buf], np.zeros(8, np.uint8)])
    blocks = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8").ravel().astype(np.uint64)
    blocks &= _FILLED[np.minimum(np.repeat(ends, many) - at, 8) - 1]
    summed = np.add.reduceat(mix(blocks ^ mix(place.astype(np.uint64), 6), 4), begin)
    return mix(summed + mix((ends - starts).astype(np.uint64), 9), 1), first


def _chunks(texts: pa.Array):
    """(first text, bytes, offsets) of consecutive texts of about CHUNK bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        base = offsets[first]
        yield first, data[base: offsets[last]], offsets[first: last + 1] - base
        first = last


def gram_sets(texts: pa.Array, n: int):
    """For every text, in order, the sorted distinct hashes of its word n-grams.

    Words are runs without white space (space, \\t to \\r), A-Z lower-cased.  A text of
    fewer words has its whole sequence as its one gram; one without words has none.
    """
    if not len(texts):
        return
    with np.errstate(over="ignore"):
        for _, buf, offsets in _chunks(texts):
            words, first = _word_hashes(buf, offsets)
            grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
            for k in range(n):
                grams += mix(words[k: k + len(grams)], 10 + k)
            grams = mix(grams, 2)
            for a, b in zip(first[:-1], first[1:]):
                if b - a >= n:
                    yield np.unique(grams[a: b - n + 1])
                elif b > a:
                    short = np.uint64(b - a)
                    for k in range(b - a):
                        short += mix(words[a + k: a + k + 1], 10 + k)[0]
                    yield mix(np.array([short], np.uint64), 3)
                else:
                    yield np.zeros(0, np.uint64)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, so many at a time, which bounds what is held for one result."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(arrays: list[np.ndarray], dtype=np.int64) -> pa.Array:
    """A list column of numpy arrays, without a copy per element."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(dtype, copy=False)))
