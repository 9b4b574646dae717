"""Fill-in-middle transformation by content-defined chunks whose summaries are remembered.

A rolling hash over the last 32 bytes cuts every text into chunks of some hundred bytes, at places that
depend on nearby content only, so that passages shared by documents fall into the same chunks.  A worker
remembers each chunk's boundary summary (code points, runs of non-blank characters, whether it begins and
ends inside a run) under the chunk's bytes, so a hit is verified by content.  Summaries combine: two
chunks have the sum of their runs, less one if a run goes on across the border.  Running sums of the
combined counts say in which chunk a document's n-th unit lies, and only that chunk is searched.

A unit is a run with the blanks before it; blanks at the end of a text are one more unit.  Texts stay in
the JVM: tasks return counts and places, and the parts are put together by SQL functions.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pretokens import give_back, per_process

#: Strings that mark the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

WINDOW = 32  # bytes that the rolling hash covers: a byte is shifted out of 32 bits after as many steps
MASK = np.uint32(0xFF << 24)  # one place in 256 is a cut
LEAST, MOST = 64, 4096  # bytes of a chunk
BLOCK = 1 << 20  # bytes hashed at a time
REMEMBERED = 32 << 20  # bytes of chunks whose summaries a worker keeps

_RUN = re.compile(rb"[^ \t-\r]+")
_BLANK = re.compile(rb"[ \t-\r]")
_GEAR = np.random.RandomState(11).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def _candidates(data: bytes) -> np.ndarray:
    """Places where the rolling hash of the bytes before them allows a cut, at code point borders."""
    found = []
    for start in range(0, len(data), BLOCK):
        lead = min(start, WINDOW - 1)
        part = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - start) + lead, start - lead)
        rolled = _GEAR[part]
        reach = 1
        while reach < WINDOW:  # sums of the last 2, 4, ... 32 bytes, older ones shifted further
            rolled[reach:] += rolled[:-reach] << np.uint32(reach)
            reach *= 2
        found.append(np.flatnonzero((rolled[lead:] & MASK) == 0) + start + 1)
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    places = places[places < len(data)]
    return places[(np.frombuffer(data, np.uint8)[places] & 0xC0) != 0x80]


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of a UTF-8 text end, in order; the last one ends the text."""
    places, ends, at = _candidates(data), [], 0
    while len(data) - at > LEAST:
        k = int(np.searchsorted(places, at + LEAST))
        end = int(places[k]) if k < len(places) else len(data)
        if end - at > MOST:
            end = at + MOST
            while data[end] & 0xC0 == 0x80:
                end -= 1
        ends.append(end)
        at = end
    return ends if at == len(data) else [*ends, len(data)]


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """Code points, runs, and whether the first and the last byte belong to a run."""
    chars = len(chunk) if chunk.isascii() else len(chunk.decode())
    return chars, len(_RUN.findall(chunk)), not _BLANK.match(chunk), not _BLANK.match(chunk, len(chunk) - 1)


class Chunks:
    """The summaries a worker remembers, bounded by the bytes of their chunks."""

    def __init__(self, limit: int) -> None:
        self.limit, self.known, self.size, self.asked, self.missed = limit, {}, 0, 0, 0

    def get(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        self.asked += 1
        found = self.known.get(chunk)
        if found is None:
            self.missed += 1
            if self.size + len(chunk) > self.limit:
                self.known, self.size = {}, 0
            found = self.known[chunk] = summary(chunk)
            self.size += len(chunk)
        return found

    def cuts(self, data: bytes, picks: tuple[int, ...]) -> tuple[int, list[int]]:
        """The number n of units of a text and, per pick, the code points in its first pick % (n + 1) units."""
        if not data:
            return 0, [0] * len(picks)
        ends = chunk_ends(data)
        found = [self.get(data[a:b]) for a, b in zip([0, *ends], ends)]
        begun, chars, inside = [0], [0], False  # runs begun and code points before each chunk
        for count, runs, opens, closes in found:
            begun.append(begun[-1] + runs - (inside and opens))
            chars.append(chars[-1] + count)
            inside = closes
        n = begun[-1] + (not inside)
        return n, [self._place(data, ends, found, begun, chars, pick % (n + 1), n) for pick in picks]

    @staticmethod
    def _place(data, ends, found, begun, chars, unit: int, n: int) -> int:
        """Code points before the end of a unit: the end of its run, found in the chunk where the run begins."""
        if unit in (0, n):
            return chars[-1] if unit else 0
        k = int(np.searchsorted(begun, unit)) - 1
        start = ends[k - 1] if k else 0
        goes_on = k > 0 and found[k - 1][3] and found[k][2]
        runs = _RUN.finditer(data, start, ends[k])
        for _ in range(unit - begun[k] + goes_on):
            run = next(runs)
        end = _BLANK.search(data, run.end())
        end = end.start() if end else len(data)
        return chars[k] + len(data[start:end].decode())


held = per_process(Chunks)


def unit_cuts(text: Column, first: Column, second: Column) -> Column:
    """A struct of n and, in ``chars``, the code points of the first pick % (n + 1) units for both picks."""
    @F.arrow_udf("n long, chars array<long>")
    def cuts(texts: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        own = held(REMEMBERED)
        rows = zip(texts.cast(pa.binary()), firsts.to_pylist(), seconds.to_pylist())
        out = [own.cuts(t.as_py(), (a, b)) for t, a, b in rows]
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array([n for n, _ in out], pa.int64()), pa.array([c for _, c in out], pa.list_(pa.int64()))], ["n", "chars"])
    return cuts(text, first, second)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
                   percent: int = 50, suffix_first: int = 80) -> DataFrame:
    """``docs`` with a struct ``fill_middle``: n units, form, prefix_chars, middle_chars and output.

    Numbers drawn from the SHA-256 of ``seed:id`` choose two cuts between units and the form, so a row's
    result depends on its id and text alone.  ``percent`` of texts are transformed, ``suffix_first`` percent of these as
    spm (suffix, prefix, middle), the others as psm.  Null and empty texts, and texts that hold a marker,
    stay plain (a null text as the empty text); a null id draws as the empty string.  Repeated rows
    come out alike, other columns stay, and a column named ``fill_middle`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("_drawn", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("_text", F.lit(mark))
    plain = (F.col("_text") == "") | marked | (drawn[2] % 100 >= percent)
    form = F.when(plain, "plain").when(drawn[3] % 100 < suffix_first, "spm").otherwise("psm")
    columns = [c for c in docs.columns if c != "fill_middle"]
    drawn_rows = docs.select(F.struct(*columns).alias("_row"), text.alias("_text"), digest.alias("_drawn"))
    cut = drawn_rows.select("_row", "_text", form.alias("_form"), unit_cuts(F.col("_text"), drawn[0], drawn[1]).alias("_cut"))
    placed = cut.select("_row", "_text", "_form", F.col("_cut.n").alias("_n"),
                        F.array_min("_cut.chars").cast("int").alias("_a"), F.array_max("_cut.chars").cast("int").alias("_b"))
    prefix = F.substring(F.col("_text"), F.lit(1), F.col("_a"))
    middle = F.substring(F.col("_text"), F.col("_a") + 1, F.col("_b") - F.col("_a"))
    suffix = F.substring(F.col("_text"), F.col("_b") + 1, F.char_length("_text"))
    marks = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}

    def joined(*order: str) -> Column:
        return F.concat(*(x for mark in order for x in (F.lit(mark), marks[mark])))
    output = (F.when(F.col("_form") == "plain", F.col("_text"))
              .when(F.col("_form") == "psm", joined(PREFIX, SUFFIX, MIDDLE)).otherwise(joined(SUFFIX, PREFIX, MIDDLE)))
    moved = F.col("_form") != "plain"
    return placed.select("_row.*", F.struct(
        F.col("_n").alias("n"), F.col("_form").alias("form"), F.when(moved, F.col("_a").cast("long")).alias("prefix_chars"),
        F.when(moved, (F.col("_b") - F.col("_a")).cast("long")).alias("middle_chars"), output.alias("output")).alias("fill_middle"))


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made.

    A transformed text held no marker, and no marker can arise across a border of its parts (each marker
    has its only ``<`` in front), so every marker stands in the output once.
    """
    after, first = F.substring_index(output, MIDDLE, -1), F.substring_index(output, MIDDLE, 1)
    first = F.substring(first, F.lit(len(PREFIX) + 1), F.char_length(output))
    psm = F.concat(F.substring_index(first, SUFFIX, 1), after, F.substring_index(first, SUFFIX, -1))
    spm = F.concat(F.substring_index(first, PREFIX, -1), after, F.substring_index(first, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
