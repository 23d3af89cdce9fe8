"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = "*", partitions: int = 8, folder: str | None = None
) -> SparkSession:
    """A local session for tests and the benchmark; ``folder`` is where it keeps tables."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanwise")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if folder is not None:
        spark.sparkContext.setCheckpointDir(folder)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder


# Set while a run keeps its tables in a folder of its own.
_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)


@contextmanager
def run_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """Tables written inside go to one folder, which is deleted at the end."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    token = _run_folder.set(path)
    try:
        yield path
    finally:
        _run_folder.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.delete(place, True)


# Shuffle files of a statement go when it ends, and not when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Statements that write a table inside leave no shuffle files behind.

    Only for writing: what is collected may be asked for again by the same plan.
    """
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` under the shared folder and return the table read back.

    The written table replaces the lineage, so a lost executor costs a re-read
    and not a recomputation, later jobs prune its columns, and what was shuffled
    for it is removed from the disks at once.
    """
    spark = df.sparkSession
    folder = _run_folder.get() or shared_folder(spark).rstrip("/")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
