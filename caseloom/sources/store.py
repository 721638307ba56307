"""Tables that are changed in place: copy-on-write of the files that hold matches, with an atomic switch.

A version is a text file that names the table's data files.  A change finds the
files that hold a match (by the scan's own ``_metadata``), writes new ones for
those alone, and creates the next version; creating a file that exists fails, so
of two changes at once one is refused and may be tried anew.  A change without a
match makes no version.  Readers of an older version keep it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another change came first."""


@dataclass(frozen=True)
class Change:
    """The rows as they are after it (deleted ones: as they were), and how many files were written anew and left."""

    rows: DataFrame
    version: int
    rewritten: int
    untouched: int


class Stored:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @classmethod
    def create(cls, df: DataFrame, path: str) -> Stored:
        made = cls(df.sparkSession, path)
        made._commit(0, made._write(df), df.schema.json())
        return made

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("versions")):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._at("versions")) if s.getPath().getName().isdigit())

    def _named(self, version: int) -> tuple[str, list[str]]:
        """Schema and data files of a version."""
        stream = self._fs.open(self._at(f"versions/{version:010d}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        schema, *files = text.split("\n")
        return schema, files

    def _commit(self, version: int, files: list[str], schema: str) -> None:
        # written aside first, so that a version is never half there
        aside = self._at(f"aside/{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write("\n".join([schema, *sorted(files)]).encode())
        stream.close()
        self._fs.mkdirs(self._at("versions"))
        to = self._at(f"versions/{version:010d}")
        # the claim fails if the version is there
        if self._fs.exists(to) or not self._fs.createNewFile(self._at(f"claims/{version:010d}")):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version} of {self.path}")
        self._fs.rename(aside, to)

    def _write(self, df: DataFrame) -> list[str]:
        """New data files, under a folder of their own."""
        own = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{own}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._at(own))]
        return [f"{own}/{n}" for n in found if n.endswith(".parquet")]

    def read(self, version: int | None = None) -> DataFrame:
        schema, files = self._named(self.versions()[-1] if version is None else version)
        return self._rows(schema, files)

    def _rows(self, schema: str, files: list[str]) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{f}" for f in files])

    def _change(self, where: Column, values: dict[str, Column] | None) -> Change:
        version = self.versions()[-1]
        schema, files = self._named(version)
        rows, match = self._rows(schema, files), F.coalesce(where, F.lit(False))
        held = {r.f for r in rows.filter(match).select(F.col("_metadata.file_path").alias("f")).distinct().collect()} if files else set()
        # a file's own folder and name tell it, whatever form its address takes
        touched = {f for f in files if any(h.endswith(f) for h in held)}
        if not touched:
            return Change(rows.limit(0), version, 0, len(files))
        old = self._rows(schema, sorted(touched))
        if values is None:
            new, told = old.filter(~match), old.filter(match)
        else:
            types = {f.name: f.dataType for f in old.schema.fields}
            set_ = {c: F.when(F.col("_match"), v.cast(types[c])).otherwise(F.col(c)) for c, v in values.items()}
            new = old.withColumn("_match", match).withColumns(set_).drop("_match")
            told = old.filter(match).withColumns({c: v.cast(types[c]) for c, v in values.items()})
        own = f"{self.path}/changes/{uuid.uuid4().hex}"
        told.write.parquet(own)
        written = self._write(new)
        self._commit(version + 1, [f for f in files if f not in touched] + written, schema)
        return Change(self.spark.read.schema(old.schema).parquet(own), version + 1, len(touched), len(files) - len(touched))

    def update(self, where: Column, values: dict[str, Column]) -> Change:
        """Sets columns of the matching rows; values read the row as it was."""
        return self._change(where, values)

    def delete(self, where: Column) -> Change:
        return self._change(where, None)

    def insert(self, df: DataFrame) -> Change:
        version = self.versions()[-1]
        schema, files = self._named(version)
        like = self._rows(schema, [])
        written = self._write(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields]))
        self._commit(version + 1, files + written, schema)
        return Change(self._rows(schema, written), version + 1, 0, len(files))
