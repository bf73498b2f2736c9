"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of this process where it is unset in
    local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='granary-')}"
    return _own[context.applicationId]


#: Paths of the tables that were made and not released, in order.
_made: list[str] = []


def made() -> list[str]:
    """The intermediate tables so far."""
    return list(_made)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes intermediate tables that nothing will read again."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _made:
            _made.remove(path)


def folder(spark: SparkSession) -> str:
    """A new path below the shared folder. What is there goes when the driver ends, or when
    it is released."""
    path = f"{shared_dir(spark).rstrip('/')}/granary-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    _made.append(path)
    return path


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Writes `df` and reads it back, which ends its lineage. The table goes when the
    driver ends. codec: of the files, where it is not that of the session."""
    path = folder(df.sparkSession)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
