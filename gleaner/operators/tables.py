"""Tables written to cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Where it names none, a new local one if Spark runs on this machine alone; a cluster's
    executors would each write to a disk of their own there, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads survive the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the tables of DataFrames that ``written`` returned, once nothing reads them any more.

    The driver's collector runs then, so that the shuffles that made such tables go as well:
    Spark removes them when their plans are collected, which a driver with memory to spare
    would put off.
    """
    found = [(df.sparkSession, path) for df in tables if (path := _paths.pop(df, None))]
    for spark, path in found:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    if found:
        found[0][0]._jvm.System.gc()
