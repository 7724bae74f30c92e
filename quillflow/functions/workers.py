"""What workers share: where they import this package from, and the folder that all of them see."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Paths given out in this process, in order.
_given: list[str] = []


def importable(df: DataFrame) -> DataFrame:
    """df itself; its session's Python workers find the package where the driver has it.

    Where executors don't have that path, ship the package with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", root)
    return df


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder of spark.checkpoint.dir; in local mode, where the session names none, below a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    _given.append(f"{folder.rstrip('/')}/quillflow/{name}-{uuid.uuid4().hex}")
    return _given[-1]


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """df computed once, written to the shared folder and read back: what reads it, several times or later, starts from there."""
    path = path or shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes what cut wrote to path, once nothing reads it any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, written and read back; what was written on the way to them is deleted."""
    first = len(_given)
    df = make()
    path = shared_path(spark, "cut")
    found = cut(df, path)
    for passed in _given[first:]:
        if passed != path:
            delete(spark, passed)
    _given[first:] = [path]
    return found
