"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), f"leafloom-{os.getuid()}")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder beside what materialize() writes; release() deletes it as well, be its writes finished or not."""
    path = f"{scratch_root(spark)}/leafloom/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Writes df once to the shared folder, in a subfolder for each value of the column by, and reads it back.

    This cuts the lineage and, unlike a local checkpoint, survives the loss of an executor.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of scratch_folder(); what reads it must be finished."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written.remove((spark, path))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are deleted as soon as it has ended, not when the driver collects its garbage."""
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


@contextmanager
def materialized(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """As materialize(), for as long as the block lasts; what reads it must be finished inside."""
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    try:
        with shuffles_dropped(spark):
            df.write.parquet(path, compression="zstd")
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        discard(spark, path)


def release(spark: SparkSession) -> None:
    """Deletes what materialize() wrote in this process; results that read it must be finished."""
    for _, path in [x for x in _written if x[0] is spark]:
        discard(spark, path)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            release(spark)
        except Exception:  # the JVM may be gone already
            pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
