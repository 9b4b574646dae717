"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

A pre-token's bytes are the leaves of a segment tree.  A leaf holds the rank of the pair
that begins there, and every node the least rank below it, so the root gives the lowest
rank and a walk down, left first, its leftmost place.  A merge sets the leaves
of the new symbol, of its live left neighbour and of the symbol it swallowed, and mends
their ways to the root: a logarithmic number of nodes.  Trees of equal size stand side by side in one
numpy array and each makes its next merge at the same time; long pre-tokens have a tree of their own.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PairTable, give_back, per_process, slices, splitter

# Trees of up to so many leaves are worked side by side.
SIDE_BY_SIDE = 64
# Pre-tokens whose ids a worker remembers; it starts anew beyond that.
REMEMBERED = 150_000
# Characters of text taken at once.
CHUNK = 500_000


def _ranks(path: str) -> dict[bytes, int]:
    """{bytes: rank} of a tiktoken file; a token's rank is its id."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Decoder:
    """The bytes of every id, one after the other."""

    def __init__(self, path: str) -> None:
        ranks = _ranks(path)
        parts = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            parts[rank] = token
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def _joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and how many there are before each id and after the last."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], lengths)
        return self.bytes[at], ends

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return self._joined(ids)[0].tobytes()

    def texts(self, ids: np.ndarray, begins: np.ndarray) -> pa.Array:
        """The bytes of texts whose ids stand one after the other."""
        joined, ends = self._joined(ids)
        offsets = pa.py_buffer(ends[begins].astype(np.int32).tobytes())
        return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, offsets, pa.py_buffer(joined.tobytes())])


class Vocabulary:
    """Ranks of a tiktoken file and the pairs of its tokens that merge."""

    def __init__(self, path: str, pattern: str) -> None:
        self.split = splitter(pattern)
        self.ranks = _ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        lefts, rights, merged = array("q"), array("q"), array("q")
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    merged.append(rank)
        self.table = PairTable(*(np.array(x, np.int64) for x in (lefts, rights, merged, merged)))
        self.forget()

    def forget(self) -> None:
        """Pre-tokens seen so far are numbered; their ids stand one after the other in ``flat``."""
        self.known: dict[str, int] = {}
        self.flat, self.begins, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _many(self, tokens: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens of at most ``size`` bytes, one tree of ``size`` leaves for each, and how many each has."""
        n, none = len(tokens), self.table.none
        lengths = np.array([len(t) for t in tokens])
        at = np.arange(n)
        symbols = np.full((size + 1, n), -1, np.int64)  # the last row stands for "no neighbour"
        row = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbols[row, np.repeat(at, lengths)] = self.single[np.frombuffer(b"".join(tokens), np.uint8)]
        after = np.repeat(np.arange(1, size + 2)[:, None], n, 1)
        after[after >= lengths] = size
        before = np.repeat(np.arange(-1, size)[:, None], n, 1)
        before[before < 0] = size
        tree = np.full((2 * size, n), none, np.int64)
        tree[size: 2 * size - 1] = self.table.find(symbols[:size - 1].ravel(), symbols[1:size].ravel())[0].reshape(size - 1, n) \
            if size > 1 else none
        for node in range(size - 1, 0, -1):
            np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])

        def update(leaf: np.ndarray, values: np.ndarray, own: np.ndarray) -> None:
            node = leaf + size
            tree[node, own] = values
            node = node >> 1
            while node[0]:
                tree[node, own] = np.minimum(tree[2 * node, own], tree[2 * node + 1, own])
                node = node >> 1

        live = at[tree[1] < none] if size > 1 else at[:0]
        while len(live):
            least, node = tree[1, live], np.ones(len(live), np.int64)
            for _ in range(size.bit_length() - 1):
                node = 2 * node
                node += tree[node, live] != least
            place = node - size
            swallowed = after[place, live]
            left, right = before[place, live], after[swallowed, live]
            merged = least  # a token's rank is its id
            symbols[place, live], symbols[swallowed, live] = merged, -1
            after[place, live] = right
            has = right < size
            before[right[has], live[has]] = place[has]
            update(swallowed, np.full(len(live), none), live)
            update(place, self.table.find(merged, symbols[right, live])[0], live)
            has = left < size
            if has.any():
                update(left[has], self.table.find(symbols[left[has], live[has]], merged[has])[0], live[has])
            live = live[tree[1, live] < none]
        kept = symbols[:size].T
        alive = kept >= 0
        return kept[alive].astype(np.int32), alive.sum(1)

    def _one(self, token: bytes) -> np.ndarray:
        """Ids of one long pre-token, with a tree of its own."""
        n, none, ranks, tokens = len(token), self.table.none, self.ranks, self.tokens

        def rank(a: int, b: int) -> int:
            return ranks.get(tokens[a] + tokens[b], none)
        size = 1 << (n - 1).bit_length()
        symbols = self.single[np.frombuffer(token, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        tree[size: size + n - 1] = [rank(a, b) for a, b in zip(symbols, symbols[1:])]
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(leaf: int, value: int) -> None:
            node = leaf + size
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
                node >>= 1

        while tree[1] < none:
            least, node = tree[1], 1
            while node < size:
                node *= 2
                node += tree[node] != least
            place = node - size
            swallowed = after[place]
            right, left = after[swallowed], before[place]
            symbols[place], symbols[swallowed], after[place] = least, -1, right
            update(swallowed, none)
            if right < n:
                before[right] = place
            update(place, rank(least, symbols[right]) if right < n else none)
            if left >= 0:
                update(left, rank(symbols[left], least))
        return np.array([s for s in symbols if s >= 0], np.int32)

    def _learn(self, tokens: set[str]) -> None:
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for token in tokens:
            raw = token.encode()
            by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append((token, raw))
        names: list[str] = []
        ids, counts = [self.flat], [self.counts]
        for size, group in by_size.items():
            names += [token for token, _ in group]
            if size > SIDE_BY_SIDE:
                alone = [self._one(raw) for _, raw in group]
                ids += alone
                counts.append(np.array([len(x) for x in alone], np.int64))
                continue
            for i in range(0, len(group), 20_000):
                flat, many = self._many([raw for _, raw in group[i: i + 20_000]], size)
                ids.append(flat)
                counts.append(many)
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names))))
        self.flat, self.counts = np.concatenate(ids), np.concatenate(counts)
        self.begins = np.cumsum(self.counts) - self.counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        out: list[np.ndarray] = []
        todo: list[list[str]] = []
        size = 0
        for k, text in enumerate(texts):
            todo.append(self.split(text))
            size += len(text)
            if size >= CHUNK or k == len(texts) - 1:
                every = set().union(*todo)
                if len(self.known) + len(every) > REMEMBERED:
                    self.forget()
                self._learn(every - self.known.keys())
                sizes = np.cumsum([len(tokens) for tokens in todo])
                number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(todo)), np.int64, sizes[-1])
                counts = self.counts[number]
                ends = np.concatenate([[0], np.cumsum(counts)])
                ids = self.flat[np.arange(ends[-1]) + np.repeat(self.begins[number] - ends[:-1], counts)]
                out += np.split(ids, ends[sizes[:-1]])
                todo, size = [], 0
        return out


vocabulary, decoder = per_process(Vocabulary), per_process(Decoder)


def _id_lists(batch: pa.RecordBatch, own: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch's texts, one after the other, and where each text's begin."""
    ids = own.encode([t or "" for t in batch.column(1).to_pylist()])
    return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """``id_col`` and ids, the token ids of each whole text; with ``decoded`` also the bytes that the
    ids stand for, decoded by the task that has them.

    Each match of ``pattern`` is merged on its own; special tokens are ordinary text.  Null and empty
    texts have no ids; rows that repeat are encoded alike; an empty table gives no rows; other columns play no
    part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(vocabulary_path, pattern)
        for batch in batches:
            # Not all texts of a batch at once, so that a worker holds a bounded number of ids.
            for part in slices(batch):
                flat, begins = _id_lists(part, own)
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(begins), pa.array(flat))]
                if decoded:
                    columns.append(decoder(vocabulary_path).texts(flat, begins))
                yield pa.record_batch(columns, ["id", "ids", "decoded"][: len(columns)])
        own.forget()
        give_back()
    schema = "id long, ids array<int>" + ", decoded binary" * decoded
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; a null list gives null, an empty one no bytes."""
    @F.arrow_udf("binary")
    def to_bytes(ids: pa.Array) -> pa.Array:
        own = decoder(vocabulary_path)
        return pa.array([None if not x.is_valid else own.decode(x.values.to_numpy(zero_copy_only=False)) for x in ids], pa.binary())
    return encoded.withColumn(out_col, to_bytes(F.col(ids_col)))
