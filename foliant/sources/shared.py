"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a new folder, but only in a session of one machine (local or local[n])."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


_written: list[tuple[SparkSession, str]] = []  # tables that written() made and nothing has deleted yet


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once for all that read it, and not held by executors.

    It stays until release() or the end of the driver's process.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Delete the tables that written() made: nothing reads them any more."""
    while _written:
        spark, path = _written.pop()
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone at the end of the process; its folder is then left to its owner
            return


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all below it; whether it was there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
