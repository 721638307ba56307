"""Inserts, updates and deletes as functions from a table to its next state and the rows they return."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.sources.schema import CASCADE, with_defaults


def overlay(df: DataFrame, patch: Mapping[str, object], where: Column | None = None) -> DataFrame:
    """Given columns replace stored ones, an explicit null too; columns that are not given stay."""
    at = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    kinds = dict(df.dtypes)
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumns({c: F.when(at, value(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in patch.items()})


def insert(df: DataFrame, table: str, rows: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(table with the new rows, the new rows with their defaults). Rows without an id get one at each evaluation: write them once."""
    made = with_defaults(rows, table, as_of)
    return df.unionByName(made), made


def update(df: DataFrame, where: Column, patch: Mapping[str, object], as_of: Column | None) -> tuple[DataFrame, DataFrame]:
    """(next state, updated rows); ``as_of`` moves updated_at, None leaves it."""
    full = dict(patch) | ({"updated_at": as_of} if as_of is not None else {})
    return overlay(df, full, where), overlay(df.filter(where), full)


def update_live(df: DataFrame, key: object, patch: Mapping[str, object], as_of: Column) -> tuple[DataFrame, DataFrame]:
    return update(df, (F.col("id") == F.lit(key)) & ~F.col("soft_delete"), patch, as_of)


def soft_delete(df: DataFrame, where: Column, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Marks rows that are not marked yet; a table without deleted_at keeps its columns."""
    patch: dict[str, object] = {"soft_delete": True}
    if "deleted_at" in df.columns:
        patch["deleted_at"] = as_of
    return update(df, where & ~F.coalesce(F.col("soft_delete"), F.lit(False)), patch, as_of)


def revoke_session(df: DataFrame, key: object, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """By id alone: a second call moves logout_time."""
    return update(df, F.col("id") == F.lit(key), {"is_active": False, "logout_time": as_of, "soft_delete": True}, as_of)


def mark_read(df: DataFrame, where: Column, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """All matching rows, read ones too, so their updated_at moves."""
    return update(df, where, {"is_read": True}, as_of)


def hard_delete(df: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(survivors, deleted rows); a null predicate deletes nothing."""
    at = F.coalesce(where, F.lit(False))
    return df.filter(~at), df.filter(at)


def delete_owned(df: DataFrame, owners: DataFrame, key: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """By a table of owners (one column ``key``)."""
    own = owners.select(key).distinct()
    return df.join(own, key, "left_anti"), df.join(own, key, "left_semi")


def cascade(patients: DataFrame, deleted: DataFrame, children: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The state after deleting patients (``deleted`` has their ids): each child table loses their rows, others are untouched."""
    gone = deleted.select("id").distinct()
    out = {"patients": patients.join(gone, "id", "left_anti")}
    for name, df in children.items():
        key = CASCADE.get(name)
        out[name] = df if key is None else df.join(gone.withColumnRenamed("id", key), key, "left_anti")
    return out
