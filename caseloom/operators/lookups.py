"""Point lookups of a request as joins over all requests at once.

No side is broadcast by hand: AQE broadcasts the side whose measured size allows it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.predicates import active_session


def authorised(requests: DataFrame, sessions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(requests whose session_id and user_id name an active session, the others)."""
    live = sessions.filter(active_session(as_of)).select(F.col("id").alias("session_id"), "user_id").distinct()
    return requests.join(live, ["session_id", "user_id"], "left_semi"), requests.join(live, ["session_id", "user_id"], "left_anti")


def session_patients(sessions: DataFrame, patients: DataFrame) -> DataFrame:
    return sessions.join(patients.withColumnsRenamed({c: f"patient_{c}" for c in patients.columns if c != "id"}).withColumnRenamed("id", "user_id"), "user_id")


def enrich(rows: DataFrame, other: DataFrame, key: str, take: list[str]) -> DataFrame:
    """Each row with columns of the one row of ``other`` that it names; rows that name none go."""
    return rows.join(other.select(key, *take), key)


def missing(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key), key, "left_anti")


def owned(rows: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a claim names by key and owner."""
    return rows.join(claims.select(*keys).distinct(), keys, "left_semi")


def free_names(new: DataFrame, taken: DataFrame, column: str, self_key: str | None = None) -> DataFrame:
    """New rows whose name nobody else has; with ``self_key``, their own row doesn't count. Null names are free.

    With ``self_key`` each name's lowest and highest holder tell whether another
    than oneself has it, so a name that many rows hold is one row of the join.
    """
    if self_key is None:
        return new.join(taken.select(column), column, "left_anti")
    held = taken.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(self_key).alias("_low"), F.max(self_key).alias("_high"))
    other = F.coalesce((F.col("_low") != F.col(self_key)) | (F.col("_high") != F.col(self_key)), F.lit(False))
    return new.join(held, column, "left").filter(~other).select(*[new[c] for c in new.columns])


def fresh_codes(new: DataFrame, taken: DataFrame, key: str, code: str, propose: Callable[[int], Column], tries: int = 5) -> DataFrame:
    """(key, code) of new rows: the first of ``tries`` proposals that no taken row and no other new row has; null if all are used.

    Of new rows that propose one code in one round, the lowest key gets it. The
    number of rounds is fixed, so the plan is too; each round's winners are kept,
    as three later steps read them.
    """
    left, used, given = new.select(*new.columns), taken.select(code).filter(F.col(code).isNotNull()), None
    for k in range(tries):
        asked = left.withColumn(code, propose(k)).join(used, code, "left_anti")
        won = asked.groupBy(code).agg(F.min(key).alias(key)).select(key, code).cache()
        given = won if given is None else given.unionByName(won)
        left = left.join(won.select(key), key, "left_anti")
        used = used.unionByName(won.select(code))
    return new.select(key).join(given, key, "left")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def mapped(values: dict[str, str], key: Column) -> Column:
    """A constant map; null for an unknown key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)
