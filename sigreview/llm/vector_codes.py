"""Vector code compression: product codebooks of integers, searched with fixed pivots (LAESA).

Vectors become integers and are cut into equal parts, each with a codebook of its own.  Distances of
every part to a few fixed pivots are computed once and written beside the integers.  In each round only
the distances of the codebook's entries to the pivots are new: by the triangle inequality the difference of two
such distances bounds the part's distance to an entry from below.  A part meets the entries in the order of
their bounds and stops when the next bound exceeds its best distance; what is evaluated is exact, in
integers.  Distances to pivots are kept as whole roots, so a bound is one less than their difference.

A round's sums per part, entry and position come from the tasks ready added, and Spark adds them up; only
the codebooks themselves reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, pin

SCALE = 4096
REACH = 1 << 27  # components (scaled) must be below this, so that all squares add up in 64 bits
ROWS = 4096  # vectors looked at together


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``_id``, ``_label`` and ``_x`` (floor of scale times each component) of vectors that
    have components, all of them finite."""
    good = (F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
            & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"), whole.alias("_x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column; all must have ``dim`` components within reach."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) != dim * len(column) or (len(column) and set(np.diff(column.offsets.to_numpy())) != {dim}):
        raise ValueError(f"vectors must all have {dim} components")
    if len(flat) and (flat.max() >= REACH or flat.min() < -REACH):
        raise ValueError(f"scaled components must be within +-{REACH}")
    return flat.reshape(len(column), dim)


def _lists(values: np.ndarray, dim: int) -> pa.Array:
    """An Arrow list column of so many integers a row."""
    ends = np.arange(0, values.size + 1, dim, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().astype(np.int32)))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of y."""
    return ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)


def _roots(squares: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down, exact for any square below 2^62."""
    roots = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    roots -= roots * roots > squares
    return roots + ((roots + 1) * (roots + 1) <= squares)


def chosen_pivots(entries: np.ndarray, many: int) -> np.ndarray:
    """So many entries that lie far from each other: the first, then whichever is farthest from those chosen."""
    picked = [0]
    while len(picked) < min(many, len(entries)):
        away = _squares(entries, entries[picked]).min(axis=1)
        picked.append(int(away.argmax()))
    return entries[picked]


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row its nearest entry (ties to the lower index), the squared distance, and the evaluations made."""
    apart = np.abs(to_pivots[:, None, :] - _roots(_squares(entries, pivots))[None, :, :]).max(axis=2)
    bounds = np.maximum(apart - 1, 0) ** 2
    order = np.argsort(bounds, axis=1, kind="stable")
    best, entry = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    going, made = np.arange(len(x)), 0
    for k in range(len(entries)):
        asked = order[going, k]
        near = bounds[going, asked] <= best[going]
        going, asked = going[near], asked[near]
        if not len(going):
            break
        found = ((x[going] - entries[asked]) ** 2).sum(axis=1)
        made += len(going)
        better = (found < best[going]) | ((found == best[going]) & (asked < entry[going]))
        best[going[better]], entry[going[better]] = found[better], asked[better]
    return entry, best, made


@dataclass(frozen=True)
class Codebooks:
    """``entries`` and ``pivots`` by part, entry and position."""

    entries: np.ndarray
    pivots: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The integers that a code stands for."""
        return np.concatenate([self.entries[p, int(code[2 * p:2 * p + 2], 16)] for p in range(len(self.entries))])


def _first_entries(whole: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids (null ids last, equal ids by their components)."""
    rows = whole.orderBy(F.col("_id").asc_nulls_last(), "_x").limit(entries).collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    dim = len(rows[0]._x)
    if dim % parts:
        raise ValueError(f"{dim} components can't be cut into {parts} equal parts")
    flat = _matrix(pa.array([r._x for r in rows], pa.list_(pa.int64())), dim)
    return flat.reshape(len(rows), parts, dim // parts).transpose(1, 0, 2)


def _with_pivots(whole: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The integer vectors with ``_far``, the whole roots of each part's distances to its pivots."""
    parts, many, width = pivots.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), parts * width).reshape(-1, parts, width)
            far = np.stack([_roots(_squares(x[:, p], pivots[p])) for p in range(parts)], axis=1)
            yield pa.record_batch([batch.column(0), batch.column(1), _lists(x, parts * width), _lists(far, parts * many)],
                                  ["_id", "_label", "_x", "_far"])
    label = whole.schema["_label"].dataType.simpleString()
    return whole.mapInArrow(run, f"_id long, _label {label}, _x array<int>, _far array<int>")


def _assigned(batches: Iterator[pa.RecordBatch], model: Codebooks) -> Iterator[tuple]:
    """Slices of batches with their parts, the entries chosen and the squared distances."""
    parts, _, width = model.entries.shape
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            batch = whole.slice(k, ROWS)
            x = _matrix(batch.column("_x"), parts * width).reshape(-1, parts, width)
            far = _matrix(batch.column("_far"), parts * model.pivots.shape[1]).reshape(len(x), parts, -1)
            found = [nearest(x[:, p], far[:, p], model.entries[p], model.pivots[p]) for p in range(parts)]
            yield batch, x, np.stack([e for e, _, _ in found], axis=1), np.stack([d for _, d, _ in found], axis=1)


def _next_entries(table: DataFrame, model: Codebooks) -> np.ndarray:
    """The entries after one more round: means of what was assigned, rounded down; unused ones stay."""
    parts, many, width = model.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * many, width), object), np.zeros(parts * many, np.int64)
        for _, x, entry, _ in _assigned(batches, model):
            for p in range(parts):
                added = np.zeros((many, width), np.int64)
                np.add.at(added, entry[:, p], x[:, p])
                sums[p * many:(p + 1) * many] += added
                counts[p * many:(p + 1) * many] += np.bincount(entry[:, p], minlength=many)
        used = np.flatnonzero(counts)
        cells = [(int(k), int(counts[k]), j, int(sums[k, j])) for k in used for j in range(width)]
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*cells), (pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["k", "n", "j", "total"])
    added = table.select("_x", "_far").mapInArrow(run, "k int, n long, j int, total long").groupBy("k", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38, 0)")).alias("total"))
    entries = model.entries.reshape(parts * many, width).copy()
    for r in added.collect():  # one row per number of the codebooks
        entries[r.k, r.j] = int(r.total) // r.n
    return entries.reshape(parts, many, width)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8,
             entries: int = 16, rounds: int = 6, pivots: int = 4, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors, and the codebooks.

    Rows: ``id_col``, ``label_col``, code (two hex digits per part), error (squared distances over
    parts) and label_error (errors over equal labels, nulls together).  Null and empty vectors and those with null
    or non-finite components are left out; vectors of another length than the first, or with components
    of 32,768 and more, are an error; ties go to the lower index; repeated rows are coded alike and all count; with fewer vectors than entries
    the codebooks have as many entries as there are vectors; an empty table gives no rows; other columns play no part.
    """
    whole = integer_vectors(vectors, id_col, vector_col, label_col, scale)
    first = _first_entries(whole, parts, entries)
    if not first.size:
        model = Codebooks(first, first)
        none = whole.limit(0).select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), F.lit("").alias("code"),
                                     F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, model
    fixed = np.stack([chosen_pivots(first[p], pivots) for p in range(parts)])
    table = pin(_with_pivots(whole, fixed))
    model = Codebooks(first, fixed)
    for _ in range(rounds):
        model = Codebooks(_next_entries(table, model), fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, entry, error in _assigned(batches, model):
            codes = ["".join(f"{e:02x}" for e in row) for row in entry.tolist()]
            yield pa.record_batch([batch.column("_id"), batch.column("_label"), pa.array(codes, pa.string()), pa.array(error.sum(axis=1))],
                                  ["_id", "_label", "code", "error"])
    label = table.schema["_label"].dataType.simpleString()
    coded = pin(table.mapInArrow(run, f"_id long, _label {label}, code string, error long"))
    sums = pin(coded.groupBy("_label").agg(F.sum("error").alias("label_error")))
    rows = join_checked(coded, sums, ["_label"], "left")
    return rows.select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), "code", "error", "label_error"), model
