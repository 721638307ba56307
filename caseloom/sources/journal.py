"""Schema changes in order, applied to old files when they are read.

Rows are written under the version of their schema (``v=3``).  A reader takes each
version's files and applies the steps that came after it; files are never
rewritten, and each file's own columns are all that is read of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.sources.schema import retyped

Step = Callable[[DataFrame], DataFrame]


def add(name: str, kind: str, default: Column | None = None) -> Step:
    return lambda df: df.withColumn(name, (F.lit(None) if default is None else default).cast(kind))


def rename(old: str, new: str) -> Step:
    return lambda df: df.withColumnRenamed(old, new)


def drop(name: str) -> Step:
    return lambda df: df.drop(name)


def retype(name: str, kind: str) -> Step:
    return lambda df: retyped(df, {name: kind})


@dataclass(frozen=True)
class Journal:
    """The first schema, and the steps since; the version is how many."""

    first: str
    steps: tuple[Step, ...] = ()

    @property
    def version(self) -> int:
        return len(self.steps)

    def then(self, *steps: Step) -> Journal:
        return Journal(self.first, (*self.steps, *steps))

    def at(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """An empty table of a version's schema."""
        return reduce(lambda df, s: s(df), self.steps[:version], spark.createDataFrame([], self.first))

    def write(self, df: DataFrame, path: str, mode: str = "append") -> None:
        """Rows of the newest schema; missing or other columns are refused."""
        want = self.at(df.sparkSession).schema
        if (got := sorted(df.columns)) != sorted(want.names):
            raise ValueError(f"columns {got} are not those of version {self.version}: {sorted(want.names)}")
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want.fields]).write.mode(mode).parquet(f"{path}/v={self.version}")

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """All rows as of the newest schema. Files of a later version than this journal's are an error."""
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        versions = sorted(int(n[2:]) for n in found if n.startswith("v=") and n[2:].isdigit())
        if versions and versions[-1] > self.version:
            raise ValueError(f"files of version {versions[-1]}, the journal ends with {self.version}")
        newest = self.at(spark)
        parts = [reduce(lambda df, s: s(df), self.steps[v:], spark.read.schema(self.at(spark, v).schema).parquet(f"{path}/v={v}")) for v in versions]
        return reduce(lambda a, b: a.unionByName(b), parts, newest) if parts else newest
