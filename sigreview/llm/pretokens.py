"""Splitting of texts before merges, and tables of merges, for both BPE operators."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

#: White space as the tokenizer libraries see it (Unicode White_Space), fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def splitter(pattern: str):
    """A function from text to its pre-tokens.

    ``pattern`` is a public tokenizer's split pattern; its \\s is spelled out, as
    libraries differ there, and ASCII texts take the same pattern with ASCII classes.
    """
    def spelled(letters: str, numbers: str, blanks: str) -> str:
        named = {"[^\\s\\p{L}\\p{N}]": f"[^{blanks}{letters}{numbers}]", "\\p{L}": f"[{letters}]",
                 "\\p{N}": f"[{numbers}]", "\\s": f"[{blanks}]", "\\S": f"[^{blanks}]"}
        return re.sub("|".join(map(re.escape, named)), lambda found: named[found[0]], pattern)
    whole = regex.compile(spelled("\\p{L}", "\\p{N}", SPACE)).findall
    ascii_only = re.compile(spelled("A-Za-z", "0-9", "\\t-\\r ")).findall
    return lambda text: ascii_only(text) if text.isascii() else whole(text)


class PairTable:
    """Pairs of symbols with a rank and the symbol they merge into; lookups take arrays.

    Open addressing in numpy: a pair's slot comes from a multiplication, and the few that
    are not found at the first slot look at the next ones.
    """

    def __init__(self, lefts: np.ndarray, rights: np.ndarray, ranks: np.ndarray, into: np.ndarray) -> None:
        """Pairs, all different, with their ranks and what they merge into."""
        keys = (lefts.astype(np.uint64) << np.uint64(32)) | rights.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, self.none, np.int32)
        self.into = np.zeros(1 << self.bits, np.int32)
        slots, todo, self.probes = self._slots(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slots[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(slots[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slots[put]] = keys[put]
            self.ranks[slots[put]], self.into[slots[put]] = ranks[put], into[put]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & self.mask

    #: The rank of pairs that don't merge.
    none = 1 << 30

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``none`` if a pair doesn't merge) and merged symbols; a symbol below 0 has no pair."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slots = self._slots(keys)
        held = self.keys[slots]
        todo = np.flatnonzero((held != keys) & (held != np.uint64(0xFFFFFFFFFFFFFFFF)))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slots[todo] = (slots[todo] + 1) & self.mask
            held = self.keys[slots[todo]]
            todo = todo[(held != keys[todo]) & (held != np.uint64(0xFFFFFFFFFFFFFFFF))]
        good = (self.keys[slots] == keys) & (left >= 0) & (right >= 0)
        return np.where(good, self.ranks[slots], np.int32(self.none)).astype(np.int64), self.into[slots].astype(np.int64)


def per_process(build):
    """Remember what ``build`` returns for its arguments in each worker process."""
    held: dict = {}

    def get(*args):
        if args not in held:
            held[args] = build(*args)
        return held[args]
    return get


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that only some of its texts are Python strings at a time."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def give_back() -> None:
    """Return freed memory to the machine: a worker process lives on after its task, beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own counsel
        pass
