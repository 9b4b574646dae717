"""Packing of token sequences: best fit planned over a histogram of lengths.

Texts become pieces of at most ``size`` tokens.  Only the number of pieces of each length reaches the
driver (at most ``size`` numbers, whatever the input), and best fit over these counts gives a plan:
lengths from the longest, each into the fullest sequences that take it, whole stretches of equal
sequences at a time.  The plan has few slots: a slot uses up a stretch, which leaves less than half of
its room, or a length, which splits one stretch; so there are at most about 3 size log2(size) of them.
Every piece then takes its place in the plan by its rank within its length.

Ranks come from no sort and no group: a task numbers its pieces of each length as it writes them, and
the counts per task and length, summed up over the tasks, say where each task's ranks begin.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_checked, pin
from .pretokens import give_back, per_process

PIECE = "id long, piece int, start long, length long, ids_crc32 long, ids array<int>, task int, rank long"
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64()]
CHUNK = 8 << 20  # bytes of text encoded at a time
REMEMBERED = 1_200_000  # words that a worker remembers
# Letters that stay as they are or fall to one lower-case letter, then ASCII punctuation.
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@[-`{-~]*)").fullmatch


@per_process
def bare(path: str):
    """The same tokenizer for words that are lower-case letters already: it neither normalises nor looks for borders."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.normalizer = normalizers.Sequence([])
    found.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return found


@per_process
def tokenizer(path: str):
    """The library's tokenizer of a file, on one thread: Spark's tasks already use the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Words:
    """Ids of texts by way of their words, which a worker remembers in one array.

    For tokenizers in which white space only keeps words apart: no token and no rule of theirs reaches across it,
    so a text's ids are those of its words in a row, and the library sees each word once.  Arrow splits the
    texts and numbers their words; the ids are then gathered by numpy.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.bare = tokenizer(path), bare(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # tokens that end a pre-token
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _remember(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.slots)
        self.slots.update(zip(words, range(first, first + len(words))))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes, self.flat = np.append(self.sizes, sizes), np.append(self.flat, ids)

    def learn(self, words: list[str]) -> None:
        """Let the library encode new words.

        Plain ones are letters and then punctuation.  The library sees their letters once, in lower case as it would make
        them, many in a row: each is one pre-token, and the tokens that end one show the borders.  Their punctuation, and all
        other words, go alone; so does everything should the ends not add up.
        """
        plain, other, heads, tails, at = [], [], {}, {"": 0}, []
        for word in words:
            found = _PLAIN(word)
            if found:
                head, tail = found.groups()
                plain.append(word)
                at.append((heads.setdefault(head.lower(), len(heads)), tails.setdefault(tail, len(tails))))
            else:
                other.append(word)
        if plain:
            ids = np.array(self.bare.encode_batch_fast([" ".join(heads)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(heads) and ends[-1] == len(ids):
                rest, counts = self._alone(list(tails))
                # Every word is two stretches: its letters, then its punctuation behind all letters.
                pair = np.array(at) + [0, len(heads)]
                sizes = np.concatenate([np.diff(ends, prepend=0), counts])
                starts = np.cumsum(sizes) - sizes
                self._remember(plain, np.concatenate([ids, rest])[_stretches(starts[pair.ravel()], sizes[pair.ravel()])], sizes[pair].sum(axis=1))
            else:
                other = words
        if other:
            self._remember(other, *self._alone(other))

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in found for i in x], "<u4"), np.array([len(x) for x in found])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text begins, the end included."""
        split = pc.ascii_split_whitespace(texts)
        named = split.flatten().dictionary_encode()
        words = named.dictionary.to_pylist()
        known = self.slots.get
        slots = np.array([known(w, -1) for w in words], np.int64)
        new = np.flatnonzero(slots < 0).tolist()
        if len(self.slots) + len(new) > REMEMBERED:
            self.forget()
            new = range(len(words))
        if new:
            self.learn([words[k] for k in new])
            slots[new] = [self.slots[words[k]] for k in new]
        slots = slots[named.indices.to_numpy()]
        sizes = self.sizes[slots]
        before = np.concatenate([[0], np.cumsum(sizes)])
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        return self.flat[_stretches(self.starts[slots], sizes)], before[borders]


words_of = per_process(Words)


def _whole(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The same for any tokenizer, text by text."""
    found = [tokenizer(path).encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    return np.array([i for x in found for i in x], "<u4"), np.cumsum([0, *map(len, found)])


def lots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about CHUNK bytes of text (column 1), a longer text alone."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy())
    first = 0
    while first < batch.num_rows:
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + CHUNK, "right")))
        yield batch.slice(first, last - first)
        first = last


def pieces(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
           size: int = 2048, end_id: int = 0, with_ids: bool = False, words_apart: bool = True) -> DataFrame:
    """Pieces of every document, in the columns of ``PIECE``; ``ids`` is null unless asked for.

    A document is its text's ids and ``end_id``.  ``rank`` counts the pieces of equal length in a ``task``:
    write the result once before both are used.  ``words_apart`` says that white space only separates words
    in this vocabulary (see :class:`Words`); without it the library gets whole texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ranks, end = TaskContext.get().partitionId(), defaultdict(int), end_id.to_bytes(4, "little")
        for batch in batches:
            for part in lots(batch):
                rows, texts = [], part.column(1).fill_null("")
                ids, borders = words_of(vocabulary_path).ids(texts) if words_apart else _whole(texts, vocabulary_path)
                for name, a, b in zip(part.column(0).to_pylist(), borders[:-1].tolist(), borders[1:].tolist()):
                    whole = ids[a:b].tobytes() + end
                    for k, start in enumerate(range(0, len(whole), 4 * size)):
                        cut = whole[start:start + 4 * size]
                        length = len(cut) // 4
                        rows.append((name, k, start // 4, length, zlib.crc32(cut), np.frombuffer(cut, "<u4") if with_ids else None,
                                     task, ranks[length]))
                        ranks[length] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=[n.split()[0] for n in PIECE.split(", ")])
        give_back()
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, PIECE)


def plan(counts: Mapping[int, int], size: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Slots of each length, and the number of sequences.

    A slot (first rank, each, first sequence, offset) takes ranks from its first one on: ``each`` pieces to
    a sequence, side by side from the offset.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: stretches (first sequence, how many) of open sequences
    frees: list[int] = []
    made = 0

    def put(free: int, first: int, many: int) -> None:
        if free and many:
            if free not in room:
                room[free] = []
                insort(frees, free)
            room[free].append((first, many))

    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    for length in sorted(counts, reverse=True):
        left, rank, slots[length] = counts[length], 0, []
        while left:
            k = bisect_left(frees, length)
            if k == len(frees):
                many = -(-left // (size // length))
                put(size, made, many)
                made += many
                continue
            free = frees[k]
            first, many = room[free].pop()
            if not room[free]:
                del room[free]
                frees.pop(k)
            each = free // length
            slots[length].append((rank, each, first, size - free))
            taken = min(left, many * each)
            full, rest = divmod(taken, each)
            put(free - each * length, first, full)
            put(free - rest * length, first + full, 1 if rest else 0)
            used = full + bool(rest)
            put(free, first + used, many - used)
            left -= taken
            rank += taken
    return slots, made


def pack(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
         size: int = 2048, end_id: int = 0, with_ids: bool = False, words_apart: bool = True) -> DataFrame:
    """Every piece with its sequence_id and its offset there; sequences are gapless from 0.

    Columns: ``id_col``, piece, start, length, ids_crc32, ids (null unless asked for), sequence_id, offset.
    Null and empty texts are the end token alone; texts of more than ``size`` tokens give several pieces, anything else
    stays whole; repeated rows and equal ids are documents of their own; a null id stays null; other
    columns play no part; an empty table gives no rows.  Sequences are numbered from 0.
    """
    cut = pin(pieces(docs, vocabulary_path, id_col, text_col, size, end_id, with_ids, words_apart))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    begins = pin(tasks.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")))
    counts = {r.length: r.n for r in begins.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(counts, size)
    planned = docs.sparkSession.createDataFrame(
        list(slots.items()), "length long, slots array<struct<first: long, each: long, sequence: long, offset: long>>")
    ranked = join_checked(cut, begins.drop("n"), ["length", "task"], "inner").withColumn("_rank", F.col("begin") + F.col("rank"))
    placed = ranked.join(F.broadcast(planned), "length").withColumn(
        "_slot", F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("_rank")), -1))
    within = F.col("_rank") - F.col("_slot.first")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "ids",
        (F.col("_slot.sequence") + F.floor(within / F.col("_slot.each"))).cast("long").alias("sequence_id"),
        (F.col("_slot.offset") + within % F.col("_slot.each") * F.col("length")).cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids of each sequence and the borders of its pieces; of pieces with ids.

    A sequence holds at most ``size`` tokens, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", F.flatten(F.col("_p.ids")).alias("ids"), F.col("_p.offset").alias("starts"))
