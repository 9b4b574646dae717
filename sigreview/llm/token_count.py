"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch are one flat array of symbols with an offset for each.  In every
round each pre-token applies its own lowest-ranked pair wherever it stands, all pre-tokens at the same
time; those without a pair that merges leave with the number of symbols they have left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PairTable, give_back, per_process, slices, splitter

# Pre-tokens whose counts a worker remembers; it starts anew beyond that.
REMEMBERED = 200_000
# Characters of text taken at once.
CHUNK = 1_000_000

#: The split pattern that byte-level tokenizer files name by "use_regex".
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable bytes for
    themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Counter:
    """Counts tokens as the library of a byte-level BPE file does."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.single = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.table = PairTable(*(np.array(x, np.int64) for x in (
            [vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges])))
        # By default the library keeps added tokens whole wherever they stand in a text.
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = splitter(PATTERN)
        self.known: dict[str, int] = {}

    def survivors(self, tokens: list[bytes]) -> np.ndarray:
        """Number of symbols that each pre-token has left when no pair merges any more."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        counts = lengths.copy()
        names = np.flatnonzero(lengths > 1)
        symbols = self.single[np.frombuffer(b"".join(tokens[k] for k in names), np.uint8)]
        sizes = lengths[names]
        while len(names):
            first = np.cumsum(sizes) - sizes
            ranks = np.full(len(symbols), PairTable.none, np.int64)
            ranks[:-1], into = self.table.find(symbols[:-1], symbols[1:])
            ranks[first + sizes - 1] = PairTable.none  # no pair reaches into the next pre-token
            least = np.minimum.reduceat(ranks, first)
            going = least < PairTable.none
            counts[names[~going]] = sizes[~going]
            if not going.any():
                break
            chosen = np.flatnonzero((ranks == np.repeat(least, sizes)) & (ranks < PairTable.none))
            # In a run like aaaa every second pair from its left end merges.
            run = np.concatenate([[True], np.diff(chosen) > 1])
            begin = np.maximum.accumulate(np.where(run, chosen, 0))
            chosen = chosen[(chosen - begin) % 2 == 0]
            symbols[chosen] = into[chosen]
            stays = np.repeat(going, sizes)
            stays[chosen + 1] = False
            sizes = np.add.reduceat(stays.astype(np.int64), first)[going]
            names, symbols = names[going], symbols[stays]
        return counts

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of every text."""
        out: list[int] = []
        todo: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            extra, parts = 0, [text]
            for special in self.added:
                if special in text:
                    extra += sum(p.count(special) for p in parts)
                    parts = [q for p in parts for q in p.split(special)]
            todo.append((extra, self.split(text) if len(parts) == 1 else [t for p in parts for t in self.split(p)]))
            size += len(text)
            if size >= CHUNK or k == len(texts) - 1:
                every = set().union(*(tokens for _, tokens in todo))
                if len(self.known) + len(every) > REMEMBERED:
                    self.known = {}
                new = list(every - self.known.keys())
                self.known.update(zip(new, self.survivors([t.encode() for t in new]).tolist()))
                known = self.known.__getitem__
                out += [extra + sum(map(known, tokens)) for extra, tokens in todo]
                todo, size = [], 0
        return out


counter = per_process(Counter)


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8) and n_tokens of each whole text.

    No begin, end or padding tokens; an added token inside a text is one token.  Null and empty texts
    have none; rows that repeat count alike; an empty table gives no rows; other columns play no part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary_path)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                                       pa.array(own.counts(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])
        own.known = {}
        give_back()
    out = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
