"""Folders for what a query writes and reads again: in the cluster's shared folder, gone when Python exits."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which executors share. Where that is unset it is a temporary folder in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        at = tempfile.mkdtemp(prefix="factlake-")
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def keep(df: DataFrame, path: str) -> DataFrame:
    """A table written and read again, so that what follows doesn't compute it anew."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """keep() in a new folder."""
    return keep(df, scratch(df.sparkSession, name))


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The place of a folder on a local or mounted disk, else None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    place = files.makeQualified(at).toUri()
    return place.getPath() if place.getScheme() == "file" and os.path.isdir(place.getPath()) else None


def _unlink(at: str) -> None:
    """Delete a local folder's files one by one, as a list of them all may not fit the driver."""
    with suppress(OSError), os.scandir(at) as found:
        for e in found:
            if e.is_dir(follow_symlinks=False):
                _unlink(e.path)
            else:
                with suppress(OSError):
                    os.unlink(e.path)


def _clear() -> None:
    for path, spark in _MADE.items():
        if spark.sparkContext._jsc is not None:  # stopped: its folder goes with the cluster's own clean-up
            if (local := local_folder(spark, path)) is not None:
                _unlink(local)
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.clear()


atexit.register(_clear)
