"""Session set-up and the shared folder for pinned intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "sigreview", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the one given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a temporary folder is used for local masters only: on a
    cluster other machines could not read it, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        known = context.getCheckpointDir()
        if known is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            known = tempfile.mkdtemp(prefix="sigreview-")
            context.setCheckpointDir(known)
        folder = known
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    _made.append(f"{shared_folder(spark).rstrip('/')}/sigreview-{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was pinned or staged within; for jobs whose result is out by then."""
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            remove(spark, _made.pop())


def _store(spark: SparkSession, path: str):
    """The file system a path is on, as Spark sees it, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def is_folder(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place) and store.getFileStatus(place).isDirectory()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    store, place = _store(spark, path)
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    store, place = _store(spark, path)
    store.delete(place, True)


def pin(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the written rows.

    This cuts the lineage like a checkpoint, but as Parquet: later steps read
    only the columns they need, and Spark knows the size of what was written.
    """
    path = scratch_path(df.sparkSession, "pinned")
    written = _written(df, path)
    written.pinned_at = path
    return written


def unpin(*pinned: DataFrame) -> None:
    """Delete what :func:`pin` wrote, where all that was derived from it is written too."""
    for df in pinned:
        remove(df.sparkSession, df.pinned_at)


@contextmanager
def pinned(df: DataFrame) -> Iterator[DataFrame]:
    """df written like :func:`pin`, to be read several times within; deleted at the end."""
    path = scratch_path(df.sparkSession, "pinned")
    try:
        yield _written(df, path)
    finally:
        remove(df.sparkSession, path)


#: Spark's setting by which a statement deletes its shuffle files when it ends, not when the driver's memory is next cleaned.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Tables written within leave no shuffle files behind; the session's setting comes back."""
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_END, before) if before else spark.conf.unset(SHUFFLES_END)


def _written(df: DataFrame, path: str) -> DataFrame:
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
