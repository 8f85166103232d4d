"""Tables cut from their lineage in the folder that the cluster shares, and small helpers on frames."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of its own only where that is unset and the executors are in this process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of few and small enough rows that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


#: Has Spark delete the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def cut(frame: DataFrame) -> DataFrame:
    """The frame's rows from a Parquet table in the shared folder: computed once, kept when executors are lost.

    The shuffle files behind it are deleted as soon as the table is written.
    """
    spark = frame.sparkSession
    bound_batches(spark)
    name = f"{shared_folder(spark)}/loom-{uuid.uuid4().hex}"
    with _cleaned(spark):
        frame.write.parquet(name)
    path, fs = _path(spark, name)
    fs.deleteOnExit(path)
    out = spark.read.schema(frame.schema).parquet(name)
    out._loom_path = name
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder within the shared one, as a path that the driver and all workers open themselves."""
    path, fs = _path(spark, f"{shared_folder(spark)}/{name}")
    if fs.getScheme() != "file":
        raise ValueError("spark.checkpoint.dir must be a mounted folder (file://), as workers map files in it")
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toUri().getPath()


def drop(frame: DataFrame) -> None:
    """Deletes the table behind a frame from cut(), once nothing reads it any more."""
    path, fs = _path(frame.sparkSession, frame._loom_path)
    fs.delete(path, True)


def fresh(taken: Iterable[str], name: str) -> str:
    """The name, with as many underscores before it as it takes to differ from all that are taken."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def forget_plans(spark: SparkSession) -> None:
    """Has the driver collect the plans of finished steps, so that an operator of many steps doesn't let its heap grow to the limit.

    Nothing depends on it but the driver's memory: tables and shuffles are deleted by cut() and drop().
    """
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_column: str, parts: int) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo parts; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == 2, F.lit(False))
