"""Parquet sinks: a result is staged beside its place, checked, and put there by a rename."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FILE_BYTES, SORTED_BYTES = 128 << 20, 32 << 20  # a task sorts a whole file


def _system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    p, system = _system(spark, path)
    return system.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p, system = _system(spark, path)
    system.delete(p, True)


def _move(spark: SparkSession, old: str, new: str) -> None:
    p, system = _system(spark, old)
    if not system.rename(p, _system(spark, new)[0]):
        raise OSError(f"{old} can't be renamed to {new}")


def target(spark: SparkSession, path: str, name: str = "query.parquet") -> str:
    """Where a result goes: into a file of this name below a folder that is there and holds no result of Spark's, else to path itself."""
    p, system = _system(spark, path)
    folder = system.exists(p) and system.getFileStatus(p).isDirectory()
    return f"{path.rstrip('/')}/{name}" if folder and not _there(spark, f"{path.rstrip('/')}/_SUCCESS") else path


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's path that the driver and all executors share: below spark.checkpoint.dir; a local session without one uses this machine's."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return f"{top.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def laid_out(df: DataFrame, sort: Sequence[str] = (), file_bytes: int = FILE_BYTES) -> DataFrame:
    """df in as many partitions as its estimated bytes make files of file_bytes; with sort, in ranges of these columns and sorted, so that filters on the first skip files and row groups.

    Without sort nothing is shuffled: small partitions are put together, and none is split.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # an upper bound, often far above
    files = max(1, min(-(-size // file_bytes), 1 << 16))
    if sort:
        return df.repartitionByRange(files, *sort).sortWithinPartitions(*sort)
    return df.coalesce(files)


def write(
    df: DataFrame, path: str, one_file: bool = False, sort: Sequence[str] = (), file_bytes: int | None = None, name: str = "query.parquet", row_group_bytes: int | None = None
) -> str:
    """Parquet, in the place of what was there; returns where. one_file only for small results.

    The rows are written beside the place and counted on the way; only if the files' footers tell as many are they renamed into
    it, and what was there is deleted last. A job that fails leaves the old result as it was. On stores that copy for a rename, the
    swap takes as long as the copy and readers may meet a moment without a result; the old one is never lost.
    """
    spark = df.sparkSession
    path = target(spark, path, name).rstrip("/")
    staged, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("staged", "old"))
    seen = Observation()
    if one_file:
        df = df.coalesce(1)
    elif sort or file_bytes:
        df = laid_out(df, sort, file_bytes or (SORTED_BYTES if sort else FILE_BYTES))
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    try:
        writer.parquet(staged)
        found, expected = spark.read.schema(df.schema).parquet(staged).count(), seen.get["rows"]  # counted from footers
        if found != expected:
            raise OSError(f"{found} of {expected} rows were written to {path}")
    except BaseException:
        _delete(spark, staged)
        raise
    before = _there(spark, path)
    if before:
        _move(spark, path, old)
    try:
        _move(spark, staged, path)
    except BaseException:
        if before:
            _move(spark, old, path)
        _delete(spark, staged)
        raise
    if before:
        _delete(spark, old)
    return path
