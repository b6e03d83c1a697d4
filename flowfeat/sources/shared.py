"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_local: dict[int, str] = {}
_paths: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode, where it is unset, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = id(spark.sparkContext)
    if key not in _local:
        _local[key] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _local[key]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start from files, not from its plan.

    The files outlive lost executors, unlike cached blocks or local checkpoints.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def drop(df: DataFrame) -> None:
    """Removes what ``cut`` wrote for df: for tables that nothing to come reads again, as those of a round that the next one has replaced."""
    if path := _paths.pop(id(df), None):
        spark = df.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
