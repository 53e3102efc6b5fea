"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset a temporary one, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="observatory-"))
    return f"file://{_own_folder[0]}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes the rows as Parquet into the shared folder and returns a scan of them.

    The result has no lineage behind it, so an executor that is lost later costs
    one read instead of the whole history; nothing is kept on executors' disks.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, which ``clear`` deletes with what lies in it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes what ``cut`` has written in this process so far, and returns how many folders that were.

    For callers that have stored or collected their results: frames that still read
    these folders fail from then on.
    """
    gone = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
