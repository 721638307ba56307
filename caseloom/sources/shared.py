"""Tables that outlive an executor: written where driver and executors both read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session that has none gets a temporary one, on a cluster that is an error."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="caseloom-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


_MARKED: set[str] = set()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path that nothing has, under the application's own folder, which goes when the driver ends."""
    base = f"{shared_dir(spark)}/caseloom-{spark.sparkContext.applicationId}"
    if base not in _MARKED:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and read from shared files after that; partitions and their order stay."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
