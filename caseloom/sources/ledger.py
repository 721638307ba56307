"""Mail and push from a stream, with a ledger of what was delivered.

Each row has a key.  A batch sends the rows that the ledger doesn't have as sent,
writes what became of each (sent, failed with its error, skipped where there is
no way to deliver), and goes on: a bad row stops nothing, and a batch that is
repeated sends only what is left.  A row whose task dies after it was sent and
before the ledger was written is sent again with the same key, by which the
receiver can tell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, status string, error string, batch bigint"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(key, status, error, batch): the ledger, empty before its first batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def sender(path: str, key: str, deliver: Callable[[str, dict], None] | None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: deliver(key, row) for each row that isn't sent yet. Rows of one key are one; those without a key fail."""

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        sent = entries(spark, path).filter("status = 'sent'").select("key")
        rows = df.withColumn("_key", F.col(key).cast("string"))
        due = rows.filter("_key is not null").dropDuplicates(["_key"]).join(sent, F.col("_key") == F.col("key"), "left_anti").unionByName(rows.filter("_key is null"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, status, errors = b.column("_key").to_pylist(), [], []
                for k, row in zip(keys, b.drop_columns(["_key"]).to_pylist(), strict=True):
                    try:
                        if k is None:
                            raise ValueError("no key")
                        if deliver is not None:
                            deliver(k, row)
                        status.append("skipped" if deliver is None else "sent")
                        errors.append(None)
                    except Exception as e:  # what a delivery raises is the row's error
                        status.append("failed")
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(status, pa.string()), pa.array(errors, pa.string())], ["key", "status", "error"])

        told = due.mapInArrow(work, "key string, status string, error string")
        told.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("append").parquet(path)

    return run


def outcome(spark: SparkSession, path: str) -> DataFrame:
    """(key, status, attempts): sent if any attempt was."""
    rank = F.when(F.col("status") == "sent", 2).when(F.col("status") == "skipped", 1).otherwise(0)
    return entries(spark, path).groupBy("key").agg(F.max_by("status", rank).alias("status"), F.count(F.lit(1)).alias("attempts"))
