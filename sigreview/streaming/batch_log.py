"""A table that grows by micro-batches: each appends its own rows, and readers fold what earlier ones left.

One partitioned Parquet folder: ``kind=changes/batch=n`` has what batch n appended, ``kind=base/batch=n`` what all
batches up to n come to.  Spark's dynamic partition overwrite writes a partition, so a replayed batch
replaces its own rows.  Readers take the newest base before their batch and the changes since.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import names_in, remove

CHANGES, BASE = "changes", "base"

# Rows of a base that one task writes to one file.
ROWS_PER_FILE = 2_000_000


class BatchLog:
    """``fold`` turns rows of several batches (columns of ``schema`` and ``batch``) into the rows they come to.

    Folding folded rows with later ones must give what folding all of them gives.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, fold: Callable[[DataFrame], DataFrame],
                 every: int = 16, rows_per_file: int = ROWS_PER_FILE) -> None:
        self.spark, self.root, self.schema, self.fold = spark, root.rstrip("/"), schema, fold
        self.every, self.rows_per_file = every, rows_per_file

    def batches(self, kind: str) -> list[int]:
        """The batches that have rows of a kind, oldest first, by the names of their folders."""
        names = names_in(self.spark, f"{self.root}/kind={kind}")
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows = rows.select(*self.schema.fieldNames()).withColumns({"kind": F.lit(kind), "batch": F.lit(batch)})
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("kind", "batch").parquet(self.root))

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write the rows of a batch; they may come from :meth:`before` of the same batch."""
        self._write(rows, CHANGES, batch)

    def start(self, rows: DataFrame) -> None:
        """Write what was there before the first batch, once."""
        if not self.batches(BASE):
            self._write(rows, BASE, -1)

    def rows(self, upto: int | None = None) -> DataFrame:
        """Rows of the newest base up to a batch (by default of all) and of the changes after it, with their batch."""
        def within(n: int) -> bool:
            return upto is None or n <= upto
        base = max((n for n in self.batches(BASE) if within(n)), default=None)
        later = [n for n in self.batches(CHANGES) if within(n) and (base is None or n > base)]
        paths = [f"{self.root}/kind={BASE}/batch={base}"] if base is not None else []
        paths += [f"{self.root}/kind={CHANGES}/batch={n}" for n in later]
        shape = StructType([*self.schema.fields, StructField("batch", IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).option("basePath", self.root).parquet(*paths).select(*shape.fieldNames())

    def before(self, batch: int) -> DataFrame:
        """What the batches before one come to; the same whenever that batch is run."""
        return self.fold(self.rows(batch - 1))

    def now(self) -> DataFrame:
        return self.fold(self.rows())

    def compact(self, batch: int) -> bool:
        """Before batch n runs: if ``every`` batches have come since the last base, fold those before n into a new one.

        Their results are out, so only the next reader is concerned.  What the base before the last one
        covers is deleted; the last one stays for readers that are under way.
        """
        bases = self.batches(BASE)
        since = [n for n in self.batches(CHANGES) if n < batch and n > max(bases, default=-2)]
        if len(since) < self.every:
            return False
        whole = self.rows(batch - 1)
        files = max(1, -(-whole.count() // self.rows_per_file))
        self._write(self.fold(whole).repartition(files), BASE, since[-1])
        covered = max(bases, default=-2)
        for kind, gone in ((CHANGES, self.batches(CHANGES)), (BASE, [n for n in bases if n < covered])):
            for n in gone:
                if n <= covered:
                    remove(self.spark, f"{self.root}/kind={kind}/batch={n}")
        return True


def latest_per_key(key: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    """A fold that keeps the row of the newest batch for each key; a batch has one row per key."""
    def fold(rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c != "batch"]
        newest = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), "batch").alias("row"))
        return newest.select("row.*")
    return fold
