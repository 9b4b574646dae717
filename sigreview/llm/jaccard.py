"""Near duplicates by the exact Jaccard similarity of word n-gram sets.

The product of the document by n-gram incidence matrix with its transpose holds the
overlap of every two documents.  It is taken in blocks, and pairs that cannot reach the
threshold are discarded by bounds that follow from the sizes of their sets:

1. *Rare columns.*  N-grams get one order, rarer ones first.  Two sets that reach the
   threshold share a column among the first ``size - ceil(t * size) + 1`` of each, so
   only these columns are multiplied; a pair's overlap in them plus what their
   remaining sizes allow must reach ``t / (1 + t)`` of both sizes together.  Pairs left
   over are held against each other by the numbers of columns in ranges of hashes: the sets
   differ in at least as many columns as these numbers do.
2. *Blocks of whole sets.*  What is left links documents to families.  The sets of a
   family are sorted by size and cut into blocks; a pair of blocks is multiplied in full,
   column block by column block, unless their sizes differ too much to link.

Equal sets become one document first.  A column held by many documents does not give all
their pairs: its members are compared with one of them, and only those left over with the
others.  Any order of columns gives right results, so its counts may collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, keyed, partitions, pin, unpin
from .components import components
from .grams import gram_sets, mix, parts, ragged, signed
from .pretokens import give_back

# Columns of up to so many documents give all pairs of them, larger ones a star.
LIGHT = 64
# Documents in a block of the full product.
BLOCK = 256
# The order knows the counts of at most so many columns; the others count as rare.
# This bounds what is broadcast (12 bytes each) and never changes a result.
ORDER_COLUMNS = 2_000_000
# Where there are more, those come next whose bit is set in a bitmap of at most so many slots (16 MB), half as many columns.
ORDER_SLOTS = 1 << 27
# First columns are matched by ranges of hashes, one after another: only one range's shuffle files stand on disk.
PASSES = 4


def _order_bits(rows: int) -> int:
    """Bits of the hash by which columns are counted: it grows with the table."""
    return min(52, max(32, int(np.ceil(np.log2(rows + 1))) + 14))


def _count_blobs(n: int, bits: int, ranges: int):
    """Per task: the sorted distinct column hashes of each range, as gaps, and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(values, np.array([(r << bits) // ranges for r in range(ranges + 1)], np.uint64))
            part, keys, times = [], [], []
            for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if b > a:
                    part.append(r)
                    gaps = np.diff(values[a:b], prepend=np.uint64((r << bits) // ranges))
                    wide = np.uint16 if gaps.max() < 1 << 16 else np.uint32 if gaps.max() < 1 << 32 else np.uint64
                    keys.append(bytes([np.dtype(wide).itemsize]) + gaps.astype(wide).tobytes())
                    many = np.flatnonzero(counts[a:b] > 1).astype(np.uint32)
                    times.append(many.tobytes() + counts[a:b][many].astype(np.uint32).tobytes())
            return pa.record_batch([pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(times, pa.binary())],
                                   ["part", "keys", "times"])
        for batch in parts(batches):
            for grams in gram_sets(batch.column(0), n):
                held.append(mix(grams, 5) >> np.uint64(64 - bits))
                size += len(grams)
                if size >= 2_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        held = []
        give_back()
    return run


def _merge_blobs(bits: int, ranges: int):
    """Per range of columns: those counted at least twice."""
    def run(key, blobs):
        base = np.uint64((key[0].as_py() << bits) // ranges)
        held = []
        for k, t in zip(blobs.column("keys"), blobs.column("times")):
            raw = k.as_py()
            gaps = np.frombuffer(raw, {2: np.uint16, 4: np.uint32, 8: np.uint64}[raw[0]], offset=1)
            values = base + np.cumsum(gaps, dtype=np.uint64)
            many = np.frombuffer(t.as_py(), np.uint32)
            at, times = many[: len(many) // 2], many[len(many) // 2:]
            held += [values, np.repeat(values[at], times - 1)]
        values = np.concatenate(held)
        values.sort()
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        counts = np.diff(np.append(first, len(values)))
        keep = counts > 1
        return pa.table({"col": pa.array(signed(values[first[keep]])), "n": pa.array(counts[keep])})
    return run


def column_counts(docs: DataFrame, text_col: str, n: int, bits: int) -> DataFrame:
    """Columns (as hashes of ``bits`` bits) that at least two documents hold, with their counts.

    Each task sorts what it has and sends gaps, a few bytes a column.
    """
    ranges = max(32, 4 * partitions(docs))  # a range's columns are sorted in one task's memory
    blobs = docs.select(text_col).mapInArrow(_count_blobs(n, bits, ranges), "part int, keys binary, times binary")
    return blobs.groupBy("part").applyInArrow(_merge_blobs(bits, ranges), "col long, n long")


def _least_count(levels: list, most: int) -> tuple[int, int]:
    """The least count from which on there are at most ``most`` columns, of (level, count) rows, and their number."""
    upto, least = 0, 2
    for row in sorted(levels, key=lambda r: -r["level"]):
        if upto + row["count"] > most:
            least = row["level"] + 1 if row["level"] < 256 else 2 * row["level"]
            break
        upto += row["count"]
    return least, upto


def _slot_pages(shift: int):
    """Per task: the bits of its columns' slots, by pages of 65,536 slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(shift))
            starts = np.flatnonzero(np.diff(slots >> np.uint64(16), prepend=np.uint64((1 << 64) - 1)))
            for own in np.split(slots, starts[1:]) if len(slots) else []:
                page = np.zeros(1 << 16, bool)
                page[own & np.uint64(0xFFFF)] = True
                page, at = np.packbits(page, bitorder="little"), int(own[0] >> np.uint64(16))
                pages[at] = pages[at] | page if at in pages else page
        yield pa.record_batch([pa.array(list(pages), pa.int32()), pa.array([x.tobytes() for x in pages.values()], pa.binary())],
                              ["page", "bits"])
    return run


def _column_order(counts: DataFrame, bits: int, most: int, slots: int):
    """What is known of written ``column_counts``: the most frequent columns and their counts, all from a least count on, at
    most ``most``, and where there are others a bitmap with a slot for as many of these as half its slots, and its bits."""
    # Counts up to 256 as they are, larger ones by their power of two: a few hundred rows.
    level = F.expr("CASE WHEN n <= 256 THEN n ELSE shiftleft(1L, cast(floor(log2(n)) AS int)) END")
    levels = counts.groupBy(level.alias("level")).count().collect()
    least, known = _least_count(levels, most)
    table = counts.where(F.col("n") >= least).toArrow()  # at most ORDER_COLUMNS short rows
    cols = table.column("col").to_numpy().view(np.uint64)
    order = np.argsort(cols)
    total = sum(row["count"] for row in levels)
    seen, wide = np.zeros(0, np.uint8), 0
    if known < total:
        wide = max(16, min((4 * total).bit_length(), slots.bit_length() - 1))
        seen = np.zeros((1 << wide) // 8, np.uint8)
        often = counts.where(F.col("n") >= _least_count(levels, (1 << wide) // 2)[0]).select("col")
        found = often.mapInArrow(_slot_pages(bits - wide), "page int, bits binary").toArrow()
        for page, own in zip(found.column("page").to_pylist(), found.column("bits")):
            seen[page << 13: page + 1 << 13] |= np.frombuffer(own.as_buffer(), np.uint8)
    return cols[order], table.column("n").to_numpy().astype(np.uint32)[order], seen, wide


def _sketcher(n: int, percent: int, bits: int, order):
    """Per document: size, two sums that name its set, its first columns in order, its numbers of columns by ranges
    of hashes, and its key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, times, seen, wide = order.value
        for batch in parts(batches):
            sizes, one, two, firsts, spread = [], [], [], [], []
            with np.errstate(over="ignore"):
                for i, grams in enumerate(gram_sets(batch.column(1), n)):
                    size = len(grams)
                    sizes.append(size)
                    one.append(int(signed(mix(grams, 7).sum(dtype=np.uint64, keepdims=True))[0]))
                    two.append(int(signed(mix(grams, 8).sum(dtype=np.uint64, keepdims=True))[0]))
                    spread.append(_spread(grams))
                    short = size - -(-percent * size // 100) + 1 if size else 0
                    name = mix(grams, 5)
                    rank = np.zeros(size, np.uint32)
                    if len(cols) and size:
                        key = name >> np.uint64(64 - bits)
                        at = np.minimum(np.searchsorted(cols, key), len(cols) - 1)
                        rank = np.where(cols[at] == key, times[at], rank)
                    if wide:
                        slot = name >> np.uint64(64 - wide)
                        rank = np.maximum(rank, seen[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    # The least counts, then the least hashes, up to the prefix's length.
                    firsts.append(signed(name[np.lexsort((name, rank))[:short]]))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()),
                                   pa.array(two, pa.int64()), ragged(firsts), pa.array(spread, pa.binary()),
                                   batch.column(2), batch.column(3)],
                                  ["row", "n", "s1", "s2", "firsts", "spread", "_id", "_th"])
        give_back()
    return run


def _spread(grams: np.ndarray) -> bytes:
    """Numbers of columns in equal ranges of hashes, at most 255 each: a power of two of ranges, for eight columns or fewer."""
    wide = max(5, (len(grams) - 1 >> 3).bit_length())
    held = np.bincount((grams >> np.uint64(64 - wide)).astype(np.int64), minlength=1 << wide)
    return np.minimum(held, 255).astype(np.uint8).tobytes()


def _apart(one: bytes, two: bytes) -> int:
    """A number of columns that at least differ between two sets, by their spreads."""
    a, b = sorted((np.frombuffer(x, np.uint8).astype(np.int64) for x in (one, two)), key=len)
    return int(np.abs(b.reshape(len(a), -1).sum(1) - a).sum())


def _alike(percent: int):
    """Pairs whose spreads allow a link: the columns that differ are at most (1 - t) / (1 + t) of both sizes together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = np.array([_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5))], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * apart <= (100 - percent) * sizes))
    return run


def _setter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [signed(g) for g in gram_sets(batch.column(1), n)]
            yield pa.record_batch([batch.column(0), ragged(sets), batch.column(2)], ["row", "grams", "family"])
    return run


def _product(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap of every left with every right set, accumulated over blocks of shared columns."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    la, lb = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    ca, cb = np.searchsorted(shared, a), np.searchsorted(shared, b)
    ca[ca == len(shared)] = 0
    cb[cb == len(shared)] = 0
    ina, inb = (shared[ca] == a, shared[cb] == b) if len(shared) else (np.zeros(len(a), bool), np.zeros(len(b), bool))
    la, ca, lb, cb = la[ina], ca[ina], lb[inb], cb[inb]
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(shared), 2048):
        def dense(rows: np.ndarray, cols: np.ndarray, count: int) -> np.ndarray:
            out = np.zeros((count, min(2048, len(shared) - start)), np.float32)
            inside = (cols >= start) & (cols < start + 2048)
            out[rows[inside], cols[inside] - start] = 1
            return out
        total += dense(la, ca, len(left)) @ dense(lb, cb, len(right)).T
    return total


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which left and right sets reach the threshold: 100 * overlap >= percent * union."""
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    overlap = _product(left, right).astype(np.int64)
    return (100 + percent) * overlap >= percent * sizes


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect what the matrix connects, at most one for each document."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    one, two = [], []
    for i in range(len(left)):
        a = int(left[i])
        for b in right[np.flatnonzero(linked[i])].tolist():
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                one.append(a)
                two.append(b)
    return one, two


def _sorted_sets(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    rows = table.column("row").to_numpy()
    grams = table.column("grams").combine_chunks()
    flat, cuts = grams.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(grams.offsets.to_numpy()))])
    sets = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    _, first = np.unique(rows, return_index=True)  # repeated rows have the same text
    order = sorted(first.tolist(), key=lambda i: (len(sets[i]), rows[i]))
    return rows[order], [sets[i] for i in order]


def _blocks_link(rows_a, sets_a, rows_b, sets_b, percent: int, one: list, two: list) -> None:
    """Multiply two blocks unless their sizes alone rule out a link."""
    if 100 * len(sets_a[-1]) < percent * len(sets_b[0]) or 100 * len(sets_b[-1]) < percent * len(sets_a[0]):
        return
    x, y = _forest(_linked(sets_a, sets_b, percent), rows_a, rows_b)
    one += x
    two += y


def _family(percent: int):
    """Links of one family of at most BLOCK documents."""
    def run(key, table):
        rows, sets = _sorted_sets(table)
        one: list[int] = []
        two: list[int] = []
        for i in range(0, len(sets), 64):
            for j in range(i, len(sets), 64):
                _blocks_link(rows[i: i + 64], sets[i: i + 64], rows[j: j + 64], sets[j: j + 64], percent, one, two)
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})
    return run


def _grid(percent: int):
    """Links between a block of leftover documents and a block of their family."""
    def run(key, table):
        one: list[int] = []
        two: list[int] = []
        side = table.column("side").to_numpy()
        if side.min() != side.max():
            a, b = (_sorted_sets(table.filter(pa.array(side == s))) for s in (0, 1))
            _blocks_link(*a, *b, percent, one, two)
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})
    return run


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n: int = 3, percent: int = 90, light: int = LIGHT, block: int = BLOCK) -> DataFrame:
    """Per document: ``id_col``, n_shingles and component_id.

    Two documents are linked when 100 * overlap >= percent * union of their sets of word
    n-grams; component_id is the smallest id that a document reaches, itself included.
    Null and blank texts have an empty set and link with nothing.  Equal texts, also repeated
    rows, are linked.  A null id never names a component: among documents of which none has an
    id component_id is null.  Different texts under one id are different documents.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = row_components(docs, id_col, text_col, n, percent, light, block)
    return rows.select(F.col("_id").alias(id_col), "n_shingles", "component_id")


def row_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   n: int = 3, percent: int = 90, light: int = LIGHT, block: int = BLOCK) -> DataFrame:
    """Per document its key ``_id`` and ``_th`` as in ``keyed``, n_shingles and component_id as in
    ``link_components``, and whether it stays where one document of each component does: that with the
    smallest id, those without one last, then with the smallest ``_th``.  Documents without words stay."""
    # A row's own number, from its id and text: only repeats of one document share it.
    named = keyed(docs, id_col, text_col).withColumn("row", F.xxhash64("_id", "_th"))
    spark = docs.sparkSession
    bits = _order_bits(docs.count())
    counts = pin(column_counts(named, "_text", n, bits))
    order = spark.sparkContext.broadcast(_column_order(counts, bits, ORDER_COLUMNS, ORDER_SLOTS))

    sketch = pin(named.select("row", "_text", "_id", "_th").mapInArrow(
        _sketcher(n, percent, bits, order),
        "row long, n long, s1 long, s2 long, firsts array<long>, spread binary, _id long, _th long"))
    # Equal sets are one class, named by its smallest row.
    name = ["n", "s1", "s2"]
    classes = pin(sketch.where("n > 0").groupBy(*name).agg(F.min("row").alias("class")))
    copies = pin(sketch.select("row", *name).join(classes, name).where("row != class").select("row").distinct())
    passes = [pin(part) for part in _shared_columns(sketch, copies, counts, bits)]
    shared = spark.read.schema(passes[0].schema).parquet(*[p.pinned_at for p in passes])
    # What was written only to get here goes as soon as it isn't needed; so does the first columns' copy.
    order.unpersist()
    slim = pin(sketch.drop("firsts"))
    unpin(sketch, counts)
    # Light columns: all pairs, with the overlap and the last shared places.
    members = shared.where(F.col("held") <= light)
    pairs = (members.selectExpr("col", "row AS a", "n AS na", "pos + 1 AS pa")
             .join(members.selectExpr("col", "row AS b", "n AS nb", "pos + 1 AS pb"), "col")
             .where(f"a < b AND 100 * least(na, nb) >= {percent} * greatest(na, nb)")
             .groupBy("a", "b", "na", "nb")
             .agg(F.count(F.lit(1)).alias("overlap"), F.max("pa").alias("pa"), F.max("pb").alias("pb")))
    reach = f"{100 + percent} * (overlap + least(na - pa, nb - pb)) >= {percent} * (na + nb)"
    # Pairs that share a few columns by chance would chain unlike documents into one family.
    spreads = slim.where("n > 0").select("row", "spread").dropDuplicates(["row"])
    alike = (pairs.where(reach).select("a", "b", "na", "nb")
             .join(spreads.selectExpr("row AS a", "spread AS sa"), "a").join(spreads.selectExpr("row AS b", "spread AS sb"), "b")
             .select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_alike(percent), "a long, b long"))
    edges = alike.union(
        shared.where((F.col("held") > light) & (F.col("row") != F.col("pivot"))).selectExpr("row AS a", "pivot AS b")).distinct()
    families = pin(components(edges))

    # Whole sets of the documents in question, dealt by family.
    sizes = families.groupBy("component").agg(F.count(F.lit(1)).alias("held"))
    sized = pin(families.join(sizes, "component").selectExpr("node AS row", "component AS family", "held"))

    def sets(of: DataFrame) -> DataFrame:
        texts = join_checked(named.select("row", "_text"), of.select("row", "family"), ["row"], "inner")
        return texts.select("row", "_text", "family").mapInArrow(_setter(n), "row long, grams array<long>, family long")
    links = sets(sized.where(F.col("held") <= block)).groupBy("family").applyInArrow(_family(percent), "a long, b long")
    staged: list[DataFrame] = []
    if not sized.where(F.col("held") > block).isEmpty():
        large = pin(sets(sized.where(F.col("held") > block)).dropDuplicates(["row"]))
        staged.append(large)
        links = links.union(_large_families(large, shared, percent, light, block, staged))
    reached = pin(components(links))
    unpin(copies, *passes, families, sized, *staged)

    of_class = classes.join(reached.selectExpr("node AS class", "component"), "class", "left").selectExpr(
        *name, "coalesce(component, class) AS component")
    rows = slim.select("_id", "_th", *name).join(of_class, name, "left")
    least = rows.where("n > 0").groupBy("component").agg(
        F.min("_id").alias("component_id"), F.min(F.expr("struct(_id IS NULL AS no_id, _id, _th)")).alias("first"))
    return rows.join(least.withColumnRenamed("first", "_first"), "component", "left").select(
        "_id", "_th", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"),
        F.expr("n = 0 OR (_id <=> _first._id AND _th = _first._th)").alias("stays"))


def _shared_columns(sketch: DataFrame, copies: DataFrame, counts: DataFrame, bits: int) -> Iterator[DataFrame]:
    """First columns that several classes hold, with their number and least row, range by range of hashes; what a
    range needs written is deleted when the next is asked for."""
    for k in range(PASSES):
        # A range's columns leave the lists before anything shuffles, with their places.
        own = F.expr("filter(transform(firsts, (col, pos) -> named_struct('pos', pos, 'col', col)), "
                     f"x -> shiftrightunsigned(x.col, {64 - bits}) % {PASSES} = {k})")
        heads = join_checked(sketch.where("n > 0").select("row", "n", own.alias("firsts")), copies, ["row"], "left_anti")
        # Most first columns are held by one document only: what isn't counted twice goes before anything else.
        held = counts.where(F.col("col") % PASSES == k).selectExpr("col AS counted")
        postings = pin(heads.selectExpr("row", "n", "inline(firsts)").join(
            held, F.shiftrightunsigned("col", 64 - bits) == F.col("counted"), "left_semi"))
        columns = postings.groupBy("col").agg(F.count(F.lit(1)).alias("held"), F.min("row").alias("pivot")).where("held > 1")
        yield postings.join(columns, "col")
        unpin(postings)


def _large_families(large: DataFrame, shared: DataFrame, percent: int, light: int, block: int, staged: list[DataFrame]) -> DataFrame:
    """Links inside families of more than ``block`` documents; what they need written is added to ``staged``.

    First every member of a heavy column against the column's pivot; then what these
    links leave outside a family's largest component against the whole family.
    """
    own = large.select("row", "grams")
    stars = (shared.where((F.col("held") > light) & (F.col("row") != F.col("pivot"))).select("row", "pivot").distinct()
             .join(own, "row").join(own.selectExpr("row AS pivot", "grams AS other"), "pivot"))
    overlap = "size(array_intersect(grams, other))"
    first = pin(stars.where(f"{100 + percent} * {overlap} >= {percent} * (size(grams) + size(other))")
                .selectExpr("row AS a", "pivot AS b"))
    reached = pin(components(first.union(large.selectExpr("row AS a", "row AS b"))).join(
        large.selectExpr("row AS node", "family"), "node"))
    counts = reached.groupBy("family", "component").count()
    main = counts.groupBy("family").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    rest = reached.join(main, "family").where("component != main").selectExpr("node AS row")
    # Blocks of like sizes: a family's documents are dealt by the size of their sets.
    band = F.floor(F.log(F.size("grams").cast("double")) / F.log(F.lit(100 / percent)))
    dealt = large.withColumn("band", band)
    cuts = dealt.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / block).alias("cuts"))
    dealt = pin(dealt.join(cuts, ["family", "band"]).withColumn("cut", F.expr("pmod(xxhash64(row), cuts)")))
    left = dealt.join(rest, "row", "left_semi")
    # A leftover block meets each block of its own and the next bands of its family.
    sides = left.select("family", F.col("band").alias("lband"), F.col("cut").alias("lcut")).distinct()
    near = sides.withColumn("band", F.explode(F.expr("sequence(lband - 1, lband + 1)"))).join(cuts, ["family", "band"])
    near = near.withColumn("cut", F.explode(F.expr("sequence(0L, cuts - 1)"))).drop("cuts")
    cell = ["family", "lband", "lcut", "band", "cut"]
    blocks = pin(near)
    staged += [first, reached, dealt, blocks]
    zero = blocks.join(left.selectExpr("family", "band AS lband", "cut AS lcut", "row", "grams"), ["family", "lband", "lcut"])
    one = blocks.join(dealt.select("family", "band", "cut", "row", "grams"), ["family", "band", "cut"])
    both = zero.select(*cell, F.lit(0).alias("side"), "row", "grams").unionByName(
        one.select(*cell, F.lit(1).alias("side"), "row", "grams"))
    return first.union(both.groupBy(*cell).applyInArrow(_grid(percent), "a long, b long"))
