"""Readers and writers: Parquet tables, JDBC, blobs, and row sinks."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.sources.schema import with_defaults

# The largest upload and the media types it may have.
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
UPLOAD_TYPES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpg", "jpeg": "image/jpeg", "txt": "text/plain"}
# Folders by upload kind.
FOLDERS = {"PATIENT_PROFILE": "profile_image", "PATIENT_DOCUMENT": "uploads"}


def scan(spark: SparkSession, root: str, table: str, *columns: str) -> DataFrame:
    """A Parquet table, only the named columns of it; other filters and columns are pushed down by Catalyst."""
    df = spark.read.parquet(f"{root}/{table}.parquet")
    return df.select(*columns) if columns else df


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A database table in ``partitions`` ranges of a numeric key, read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key)
    return reader.option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).options(**options).load()


def insert(path: str, table: str, rows: DataFrame, as_of: Column) -> DataFrame:
    """Appends rows with their defaults and returns them as written; generated ids are settled before both."""
    made = with_defaults(rows, table, as_of)
    if "id" not in rows.columns:
        made = made.checkpoint()
    made.write.mode("append").parquet(path)
    return made


def blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Uploaded files of an allowed kind and size: path, name, media type, length, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kinds = F.create_map(*[F.lit(x) for pair in UPLOAD_TYPES.items() for x in pair])
    named = files.withColumn("name", name).withColumn("media_type", F.try_element_at(kinds, F.lower(F.element_at(F.split("name", r"\."), -1))))
    return named.filter((F.col("length") <= MAX_UPLOAD_BYTES) & F.col("media_type").isNotNull())


@lru_cache(maxsize=64)
def template(spark: SparkSession, path: str) -> str:
    """A template file, read once a session; for ``functions.text.render``."""
    return spark.read.text(path, wholetext=True).first()[0]


def object_key(kind: Column, at: Column, name: Column) -> Column:
    """folder/milliseconds-name; null for an unknown upload kind."""
    folders = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])
    folder = F.try_element_at(folders, kind)
    return F.when(folder.isNotNull(), F.concat(folder, F.lit("/"), F.unix_millis(at.cast("timestamp")).cast("string"), F.lit("-"), name))


def delete_objects(keys: DataFrame, column: str, root: str) -> DataFrame:
    """Deletes root/key for each distinct key, in the executors: (key, deleted, error). Empty and null keys and those that leave the root are refused."""

    def run(batches):
        from pyarrow import RecordBatch, array, bool_, fs, string

        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            done, errors = [], []
            for key in b.column(0).to_pylist():
                try:
                    if not key or ".." in key.split("/"):
                        raise ValueError("no key")
                    system.delete_file(f"{base}/{key}")
                    done.append(True)
                    errors.append(None)
                except (OSError, ValueError) as e:  # a missing object is a row, not a failed job
                    done.append(False)
                    errors.append(str(e))
            yield RecordBatch.from_arrays([b.column(0), array(done, bool_()), array(errors, string())], ["key", "deleted", "error"])

    return keys.select(F.col(column).alias("key")).distinct().mapInArrow(run, "key string, deleted boolean, error string")


def send_each(deliver: Callable[[list[dict]], None] | None, batch: int = 500) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for mail or push: delivers in bounded batches from the executors; without a way to deliver, rows are skipped."""

    def run(df: DataFrame, _epoch: int) -> None:
        if deliver is None:
            return

        def partition(rows):
            held = []
            for r in rows:
                held.append(r.asDict(recursive=True))
                if len(held) == batch:
                    deliver(held)
                    held = []
            if held:
                deliver(held)

        df.foreachPartition(partition)

    return run


def alive(spark: SparkSession) -> DataFrame:
    """The liveness probe."""
    return spark.range(1).select(F.lit(1).alias("ok"))
