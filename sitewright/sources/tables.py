"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at its end, when what is made of them has been written elsewhere."""
    held: list[str] = []
    _scopes.append(held)
    try:
        yield
    finally:
        _scopes.remove(held)
        for table in held:
            path = spark._jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sitewright/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where the session names none and all its tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named and not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="spark-sitewright-"))
    return (named or _local[0]).rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once and read again: what is derived from it by many branches is not computed anew by each. It stays until the `scope` around it ends."""
    path = _new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Growing:
    """A table in the shared folder that parts are added to: what is there is read, and never written again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.schema = spark, None
        self.path = _new_path(spark, name)

    def add(self, part: DataFrame) -> None:
        self.schema = self.schema or part.schema
        part.write.mode("append").parquet(self.path)

    @property
    def df(self) -> DataFrame:
        """All parts that there are by now."""
        return self.spark.read.schema(self.schema).parquet(self.path)
