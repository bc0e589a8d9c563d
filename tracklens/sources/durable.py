"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch that deletes a query's shuffle files once the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and all runs on one machine, a temporary folder is made and set."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tracklens-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
        atexit.register(shutil.rmtree, where.removeprefix("file://"), True)
    return where.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go as soon as their query has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    It cuts the lineage as ``checkpoint()`` does, in compressed columns, and survives the loss of executors. The
    files go when the application ends, or with ``dropped``; the shuffle files of the write go at its end. ``rows``: so many
    make a row group, which writer and reader hold in memory; for rows of many megabytes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with without_leftovers(spark):
        (df.write if rows is None else df.write.option("parquet.block.row.count.limit", rows)).option("compression", "zstd").parquet(path)
    fs, where = _filesystem(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # type: ignore[attr-defined]
    return out


def dropped(*dfs: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing that is still to run reads it."""
    for df in dfs:
        fs, where = _filesystem(df.sparkSession, df._stored_at)  # type: ignore[attr-defined]
        fs.delete(where, True)


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """The path of a file with these bytes in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}"
    fs, where = _filesystem(spark, path)
    if not fs.exists(where):
        out = fs.create(where)
        out.write(data)
        out.close()
        fs.deleteOnExit(where)
    return path
