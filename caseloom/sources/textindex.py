"""Substring search over large tables: trigrams of each data file, so that a search opens only files that may hold its needle.

``build`` writes the rows as files of bounded rows and, for each file, the
distinct three-character strings of its searched columns, lower-cased.
``search`` takes the needle's own trigrams (between its wildcards), opens the
files that have all of them, and lets ILIKE decide.  A needle without three
characters in a row opens every file, so rows are always those of a full scan.
``add`` appends: files never change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.predicates import all_of, like_pattern, search

ROWS_A_FILE = 1_000_000
#: Characters whose lower case depends on what stands around them, or is longer: needles with them say less.
_UNSURE = frozenset("ΣσςİIıi̇")
_BITS = 21


@dataclass(frozen=True)
class Found:
    rows: DataFrame
    files_read: int
    files: int


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, each as one number."""
    c = _codes(text)
    return np.unique(c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:]) if len(c) > 2 else np.zeros(0, np.int64)


def needle_grams(needle: str) -> set[int]:
    """Trigrams that every match holds: of the literal runs between wildcards, lower-cased."""
    runs, run, i, pattern = [], "", 0, like_pattern(needle)
    while i < len(pattern):
        if pattern[i] == "\\":
            run, i = run + pattern[i + 1], i + 2
            continue
        if pattern[i] in "%_":
            runs, run = [*runs, run], ""
        else:
            run += pattern[i]
        i += 1
    low = ["".join(c.lower() if c not in _UNSURE and len(c.lower()) == 1 else "\n\0" for c in r) for r in [*runs, run]]
    return {int(g) for r in low for piece in r.split("\n\0") for g in grams(piece)}


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, text) to (gram, file), each once a batch."""
    for b in batches:
        by: dict[str, list[str]] = {}
        for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault(f, []).append(t or "")
        for f, texts in by.items():
            # a character that no text has keeps texts apart
            g = grams("\U0010ffff\U0010ffff".join(texts))
            g = g[(g & ((1 << _BITS) - 1) != 0x10FFFF) & (g >> 2 * _BITS != 0x10FFFF) & ((g >> _BITS) & ((1 << _BITS) - 1) != 0x10FFFF)]
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array([f] * len(g), pa.string())], ["gram", "file"])


def add(df: DataFrame, columns: list[str], path: str, rows_a_file: int = ROWS_A_FILE) -> None:
    """Appends rows, then the grams of the files that have none yet."""
    spark = df.sparkSession
    df.write.mode("append").option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/data")
    rows = spark.read.parquet(f"{path}/data").select(F.col("_metadata.file_name").alias("file"), *columns)
    if (known := _indexed(spark, path)) is not None:
        rows = rows.join(F.broadcast(known.select("file")), "file", "left_anti")
    # columns are indexed each by itself: no gram reaches from one into the next
    texts = rows.select("file", F.explode(F.array(*[F.lower(F.col(c).cast("string")) for c in columns])).alias("text"))
    grams_ = texts.mapInArrow(_found, "gram bigint, file string").distinct()
    grams_.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("append").parquet(f"{path}/grams")
    # a file counts as indexed once its grams are written
    rows.select("file").distinct().withColumn("columns", F.lit(",".join(columns))).coalesce(1).write.mode("append").parquet(f"{path}/files")


def _indexed(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/files")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("file string, columns string").parquet(f"{path}/files")


def search_index(spark: SparkSession, path: str, needle: str, *columns: str, where: Column | None = None) -> Found:
    """The rows whose columns hold the needle (as ``predicates.search``), from the files that may have them; the file list is the driver's, as in any scan."""
    known = _indexed(spark, path)
    files = sorted(r.file for r in known.select("file").distinct().collect()) if known is not None else []
    data = spark.read.parquet(f"{path}/data")
    want = needle_grams(needle)
    wanted = files
    if want:
        hits = spark.read.schema("gram bigint, file string").parquet(f"{path}/grams").filter(F.col("gram").isin(*want))
        wanted = sorted(r.file for r in hits.groupBy("file").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(want)).collect())
    some = spark.read.schema(data.schema).parquet(*[f"{path}/data/{f}" for f in wanted]) if wanted else data.limit(0)
    return Found(some.filter(all_of(search(needle, *columns), where)), len(wanted), len(files))
