"""Predicates that are added only when their value is given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*parts: Column | None) -> Column:
    """Conjunction of what is given; nothing given keeps every row."""
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def any_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts)


def like_pattern(needle: str) -> str:
    """%needle%, with the wildcards of the needle alive; a backslash that escapes nothing stands for itself."""
    out, i = [], 0
    while i < len(needle):
        c = needle[i]
        if c == "\\":
            if i + 1 < len(needle) and needle[i + 1] in "%_\\":
                out.append(needle[i : i + 2])
                i += 2
                continue
            c = "\\\\"
        out.append(c)
        i += 1
    return "%" + "".join(out) + "%"


def search(needle: str | None, *columns: str) -> Column | None:
    """Case-insensitive substring search over several columns; an empty needle is no predicate, a null column no match."""
    if not needle:
        return None
    pattern = F.lit(like_pattern(needle))
    return any_of(*[F.coalesce(F.ilike(F.col(c).cast("string"), pattern), F.lit(False)) for c in columns])


def equals(column: str, value: object) -> Column | None:
    """Equality where a value is given: null and empty text count as absent, false does not."""
    return None if value is None or value == "" else F.col(column) == F.lit(value)


def not_deleted(column: str = "soft_delete") -> Column:
    """Strict: a null flag drops the row."""
    return ~F.col(column)


def not_deleted_or_unknown(column: str = "soft_delete") -> Column:
    return ~F.coalesce(F.col(column), F.lit(False))


def owned_by(owner: object, column: str = "user_id") -> Column:
    return F.col(column) == F.lit(owner)


def active_session(as_of: Column, session_id: object = None, token_hash: str | None = None) -> Column:
    """A session that is active, kept, and not expired at as_of."""
    return all_of(equals("id", session_id), equals("refresh_token_hash", token_hash), F.col("is_active"), not_deleted(), F.col("refresh_token_expires_at") > as_of)
