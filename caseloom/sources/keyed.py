"""Unique keys at insert, and files laid out for lookups by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a row group of a keyed table.
ROW_GROUP = 8 << 20


def admitted(new: DataFrame, kept: DataFrame, *keys: tuple[str, ...], order: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may be inserted, the others with ``refused``: the names of the keys they break).

    Each key is a tuple of columns; null in any of them breaks nothing. Of new rows
    that share a key the first by ``order`` may stay if it breaks no other key.
    Keys meet by equality, one shuffle each; only key columns of kept rows are read.
    """
    told = new
    for i, key in enumerate(keys):
        known = F.lit(True)
        for c in key:
            known = known & F.col(c).isNotNull()
        there = kept.select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(key)], F.lit(True).alias(f"_has{i}")).dropna().distinct()
        on = [F.col(c) == F.col(f"_k{j}") for j, c in enumerate(key)]
        told = told.join(there, on, "left").drop(*[f"_k{j}" for j in range(len(key))])
        # rows with a null share no group: their own order keeps them apart
        apart = F.when(known, F.lit(None)).otherwise(F.col(order).cast("string"))
        place = F.row_number().over(Window.partitionBy(*key, apart).orderBy(order))
        told = told.withColumn(f"_bad{i}", known & (F.coalesce(F.col(f"_has{i}"), F.lit(False)) | (place > 1))).drop(f"_has{i}")
    names = F.array_compact(F.array(*[F.when(F.col(f"_bad{i}"), F.lit("+".join(k))) for i, k in enumerate(keys)]))
    told = told.withColumn("refused", names).drop(*[f"_bad{i}" for i in range(len(keys))])
    return told.filter(F.size("refused") == 0).drop("refused"), told.filter(F.size("refused") > 0)


def write_keyed(df: DataFrame, path: str, key: str, *looked_up: str, row_group: int = ROW_GROUP, files: int | None = None) -> None:
    """Files sorted by ``key`` in ranges, in row groups of bounded size, with Bloom filters for other columns that rows are looked up by.

    A point lookup by the key reads the one row group whose range has it; by
    another column, those whose filter lets it through.
    """
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    out = ranged.sortWithinPartitions(key).write.option("parquet.block.size", row_group).option("parquet.block.size.row.check.min", 100)
    for c in looked_up:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)
