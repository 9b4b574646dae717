"""Line de-duplication over levelled sorted runs of line hashes.

A store holds runs: tables of line hashes, bucketed and sorted by hash, each hash in
one run only.  A batch of documents merge-anti-joins the runs: hashes not seen before
become a run of level 0, hashes seen before go to the store's list of repeats.  As soon
as two runs stand at one level, they are merged into one of the next level, so a batch meets
at most log2(batches) + 1 runs.  Runs are read in bucket order: neither the
anti-joins nor the merges shuffle or sort them again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove
from .common import join_checked, join_same, keyed, lower_ascii, pin, scratch_path

HASH = ["h1", "h2"]
# Batches that a whole table is cut into; a stream of batches has as many as come.
BATCHES = 4

_TRIM = "btrim(line, ' \\t\\n\\u000B\\f\\r')"


def line_hashes(rows: DataFrame, min_chars: int) -> DataFrame:
    """``_id``, ``_th``, place and the 128-bit hash of the key of every line that counts.

    ``rows`` is ``keyed`` output.  A line's key is the line without the white space around
    it and with A-Z lower-cased; keys under ``min_chars`` code points don't count.
    """
    lines = rows.select("_id", "_th", F.posexplode(F.split("_text", "\n", -1)).alias("place", "line"))
    long = lines.where(f"char_length(line) >= {min_chars}").selectExpr("_id", "_th", "place", f"{_TRIM} AS line")
    long = long.where(f"char_length(line) >= {min_chars}").selectExpr("_id", "_th", "place", f"{lower_ascii('line')} AS key")
    return long.selectExpr("_id", "_th", "place", "xxhash64(key) AS h1", "xxhash64(1, key) AS h2")


class LineStore:
    """Runs of line hashes with the number of documents and the largest id that hold each."""

    def __init__(self, spark: SparkSession, min_chars: int = 40, buckets: int | None = None) -> None:
        self.spark, self.min_chars = spark, min_chars
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []  # (level, table), oldest first
        self.repeats: list[DataFrame] = []  # written: hashes of a batch that were in the store
        self.merged: list[str] = []  # runs that stand in a larger one now

    def _write(self, df: DataFrame) -> str:
        name = f"llm_line_run_{uuid.uuid4().hex}"
        (df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
         .option("path", scratch_path(self.spark, "run")).saveAsTable(name))
        return name

    def add(self, rows: DataFrame) -> DataFrame:
        """Take in a batch (``keyed`` output) and return its hashes that are new to the store.

        Documents count once in a batch, so all rows that repeat one must come in the same batch.
        """
        return self.add_hashes(line_hashes(rows, self.min_chars))

    def add_hashes(self, hashes: DataFrame) -> DataFrame:
        """The same from ``line_hashes`` output."""
        hashes = hashes.select("_id", "_th", *HASH).distinct()
        own = hashes.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("_id").alias("last"))
        if self.runs:
            batch = self.spark.table(self._write(own.repartition(self.buckets, *HASH)))
            fresh = reduce(lambda left, run: left.join(self.spark.table(run[1]), HASH, "left_anti"), self.runs, batch)
            new = self._write(fresh)
            self.repeats.append(pin(batch.join(self.spark.table(new), HASH, "left_anti")))
        else:
            new = self._write(own.repartition(self.buckets, *HASH))
        self.runs.append((0, new))
        self._compact()
        return self.spark.table(new)

    def _compact(self) -> None:
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            (level, one), (_, two) = self.runs[-2:]
            # No hash is in both, so a merge of the sorted runs only interleaves them.
            a, b = self.spark.table(one).alias("a"), self.spark.table(two).alias("b")
            merged = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full")
            columns = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in [*HASH, "n_docs", "last"]]
            self.runs[-2:] = [(level + 1, self._write(merged.select(*columns)))]
            self.merged += [one, two]

    def clean(self, everything: bool = False) -> None:
        """Delete the runs that were merged, or all of them; what was read from them must be written by then."""
        gone = self.merged + [table for _, table in self.runs] * everything
        for table in gone:
            place = self.spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first().data_type
            self.spark.sql(f"DROP TABLE {table}")
            remove(self.spark, place)
        self.merged = []

    def totals(self) -> DataFrame:
        """Every hash with its number of documents and the largest id, over all batches."""
        seen = reduce(DataFrame.unionByName, [self.spark.table(t) for _, t in self.runs])
        if not self.repeats:
            return seen
        again = reduce(DataFrame.unionByName, self.repeats).groupBy(*HASH).agg(
            F.sum("n_docs").alias("more"), F.max("last").alias("later"))
        return seen.join(again, HASH, "left").select(
            *HASH, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"),
            F.greatest("last", "later").alias("last"))


def batches(docs: DataFrame, by: list[str], count: int = BATCHES) -> list[DataFrame]:
    """Cut a table into batches: by file where it is read from files, so that each batch
    reads its own files only, else by the hash of the columns ``by``.

    Only for tables in which no document is repeated in several files; ``dealt_hashes`` is for any.
    """
    try:
        docs.select("_metadata.file_path")
        hashed = F.xxhash64("_metadata.file_path")
    except AnalysisException:
        hashed = F.xxhash64(*by)
    return [docs.where(F.pmod(hashed, F.lit(count)) == k) for k in range(count)]


def dealt_hashes(rows: DataFrame, min_chars: int, count: int = BATCHES) -> tuple[str, list[DataFrame]]:
    """``line_hashes`` of ``keyed`` output, written once, and cut into batches by document.

    All rows of a document are in one batch, whatever files they came from, and a batch
    reads its own folder only.  Gives the folder and the batches.
    """
    path = scratch_path(rows.sparkSession, "hashes")
    hashes = line_hashes(rows, min_chars)
    dealt = hashes.withColumn("batch", F.pmod(F.xxhash64("_id", "_th"), F.lit(count)).cast("int"))
    dealt.write.partitionBy("batch").parquet(path)
    written = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    return path, [written.where(F.col("batch") == k).drop("batch") for k in range(count)]


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                        min_chars: int = 40, min_docs: int = 5, n_batches: int = BATCHES) -> DataFrame:
    """``docs`` with the column ``text_col`` without its repeated lines, and the struct
    ``line_dedup`` (n_lines, n_dropped) as last column.

    A text is cut at \\n; a null or empty text is one empty line.  Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines but
    those in the documents with the largest id that hold them.  Rows that agree in id and text are
    repeats of one document, count once and get the same result.  Documents without an id
    count, and keep a line only if no document with an id holds it.  Texts that lose
    nothing stay as they are, null included.  Other columns pass unchanged, whatever their names.
    An empty table gives no rows.  A text of any number of lines takes time in proportion to it.
    """
    store = LineStore(docs.sparkSession, min_chars)
    path, hashes = dealt_hashes(keyed(docs, id_col, text_col), min_chars, n_batches)
    for batch in hashes:
        store.add_hashes(batch)
        store.clean()
    # Only what is to be dropped: keys in enough documents.
    heavy = pin(store.totals().where(F.col("n_docs") >= min_docs).select(*HASH, "last"))
    store.clean(everything=True)
    found = join_checked(reduce(DataFrame.unionByName, hashes), heavy, HASH, "inner")
    dropped = pin(found.where("NOT (_id <=> last)").groupBy("_id", "_th")
                  .agg(F.array_sort(F.collect_set("place")).alias("places")))
    remove(docs.sparkSession, path)

    text = F.coalesce(F.col("_row")[text_col], F.lit(""))
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"))
    joined = join_same(whole, dropped, ["_id", "_th"], "left")
    lines = F.split(text, "\n", -1)
    # Both arrays are walked once: the places that stay are a difference of sets, and the lines are split once.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places"))
    kept = F.array_join(F.transform(F.array(F.struct(lines.alias("lines"), stay.alias("stay"))), lambda s: F.transform(
        s["stay"], lambda i: s["lines"][i]))[0], "\n")
    new = F.when(F.col("places").isNull(), F.col("_row")[text_col]).otherwise(kept)
    return joined.select(
        *[(new if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns],
        F.struct(F.size(lines).cast("long").alias("n_lines"),
                 F.coalesce(F.size("places").cast("long"), F.lit(0)).alias("n_dropped")).alias("line_dedup"))
