"""Exact de-duplication by two-pass Bloom filtering.

The first pass sets the bits of every text's hash in a Bloom filter and, where a bit was set
already, in a second one.  Filters of different tasks combine: the second filter of two is
what either has there, and what both have in the first.  The second pass looks every hash
up in the second filter: a hash that occurs twice has all its bits there.  Only rows that pass
shuffle to be counted exactly; all others are known to be alone and stay where they are.

A filter has a fixed number of bits per row, cut into blocks, and a hash has all its bits in one
block.  Blocks are dealt into rounds of bounded size, so a filter of any size is looked up
part by part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin

BITS_PER_ROW = 16
BLOCK_BITS = 1 << 16  # 8 KB; a hash has four 16-bit places in its block
# Blocks of one round: what is broadcast at once is at most 64 MB.
ROUND_BLOCKS = 8192
# Tasks that build filters side by side, which bounds the copies of a block that are combined.
BUILDERS = 128

NORMAL = "regexp_replace({}, '[\\\\x20\\\\x09-\\\\x0D]+', ' ')"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: for each block it met, the bits set once and those set again."""
    filters: dict[int, tuple[bytearray, bytearray]] = {}
    for batch in batches:
        for block, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if block not in filters:
                filters[block] = bytearray(BLOCK_BITS // 8), bytearray(BLOCK_BITS // 8)
            once, twice = filters[block]
            places &= 0xFFFFFFFFFFFFFFFF
            # The places of one hash, each once, so that it doesn't meet itself.
            for bit in {places & 0xFFFF, places >> 16 & 0xFFFF, places >> 32 & 0xFFFF, places >> 48}:
                byte, one = bit >> 3, 1 << (bit & 7)
                twice[byte] |= once[byte] & one
                once[byte] |= one
    for block, (once, twice) in filters.items():
        yield pa.record_batch([pa.array([block], pa.int64()), pa.array([bytes(once)], pa.binary()),
                               pa.array([bytes(twice)], pa.binary())], ["block", "once", "twice"])


def _combine(key, table):
    """All tasks' filters of a block: its second filter as 64-bit words, lowest bit first."""
    once = twice = np.zeros(BLOCK_BITS // 8, np.uint8)
    for a, b in zip(table.column("once"), table.column("twice")):
        own, again = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
        once, twice = once | own, twice | again | (once & own)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()),
                     "words": pa.array([twice.view("<i8").tolist()], pa.list_(pa.int64()))})


def possible_repeats(hashes: DataFrame, rows: int) -> DataFrame:
    """``hashes`` (a written table with long columns h1 and h2) with the column ``again``: false only
    where no other row has the same h1 and h2."""
    blocks = max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))
    dealt = hashes.withColumn("_block", F.expr(f"pmod(h1, {blocks}L)"))
    found = []
    rounds = -(-blocks // ROUND_BLOCKS)
    for k in range(rounds):
        part = dealt if rounds == 1 else dealt.where(f"_block >= {k * ROUND_BLOCKS} AND _block < {(k + 1) * ROUND_BLOCKS}")
        marks = part.select("_block", "h2").coalesce(BUILDERS).mapInArrow(_mark, "block long, once binary, twice binary")
        second = pin(marks.groupBy("block").applyInArrow(_combine, "block long, words array<long>"))
        bits = " AND ".join(
            f"getbit(words[CAST(shiftright(shiftrightunsigned(h2, {s}) & 65535, 6) AS INT)], "
            f"CAST(shiftrightunsigned(h2, {s}) & 63 AS INT)) = 1" for s in (0, 16, 32, 48))
        found.append(part.join(F.broadcast(second), F.col("_block") == F.col("block"), "left")
                     .withColumn("again", F.coalesce(F.expr(bits), F.lit(False))).drop("block", "words", "_block"))
    return reduce(DataFrame.unionByName, found)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after each run of white space (space, \\t to \\r) became one
    space; null counts as empty.  Of equal texts the row with the smallest id stays, rows without
    an id last; of rows that tie in the id, one stays.  keep_id is null if no row of the group has an
    id.  An empty table gives an empty result; other columns are ignored.
    """
    normal = NORMAL.format(f"coalesce(`{text_col}`, '')")
    digests = pin(docs.select(F.col(id_col).cast("long").alias("_id"), F.expr(f"sha2({normal}, 256)").alias("sha"))
                  .select("_id", "sha", F.monotonically_increasing_id().alias("_row"),
                          F.xxhash64("sha").alias("h1"), F.xxhash64(F.lit(1), "sha").alias("h2")))
    marked = possible_repeats(digests, digests.count())
    marked = pin(marked.drop("h1", "h2"))
    alone = marked.where("NOT again").selectExpr("_id", "_id AS keep_id", "1L AS group_size", "true AS kept", "sha")
    again = marked.where("again").drop("again")
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    groups = again.groupBy("sha").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
    counted = again.join(groups, "sha").selectExpr(
        "_id", "first.id AS keep_id", "group_size", "_row = first.row AS kept", "sha")
    return alone.unionByName(counted).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
