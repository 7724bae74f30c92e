"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Paths given out in this process, in order.
_given: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode (tests) where the session names none.

    On a cluster a folder of the driver's machine would lose what other executors write, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    _given.append(f"{shared_dir(spark)}/quillflow/{name}-{uuid.uuid4().hex}")
    return _given[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back; later stages restart from that copy."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def only_result(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows as a stored table; the tables that make stored on its way are deleted, the result needs them no more."""
    first = len(_given)
    df = make()
    path = fresh_path(spark, name)
    df.write.parquet(path)
    for passed in _given[first:]:
        if passed != path:
            delete(spark, passed)
    _given[first:] = [path]
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Python workers import this package from where the driver has it, and bounds an Arrow batch.

    Where executors don't have the driver's path, ship the package with ``--py-files``.  Bounds that the
    application was started with stay as they are.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    for name, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 16 << 20)):
        if not spark.sparkContext.getConf().contains(f"spark.sql.execution.arrow.{name}"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
