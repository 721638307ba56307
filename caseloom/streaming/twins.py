"""Structured Streaming twins of the batch state operators.

Watermarks need a TIMESTAMP column: cast tz-less times first (session time zone UTC).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caseloom.operators.state import MAX_ATTEMPTS, WINDOW_LIMIT, WINDOW_MINUTES


def over_limit(events: DataFrame, key: str, at: str, late: str = "30 minutes", minutes: int = WINDOW_MINUTES, limit: int = WINDOW_LIMIT) -> DataFrame:
    """As the batch twin; a window is given once the watermark has passed it, and later events are dropped."""
    counted = events.withWatermark(at, late).groupBy(F.col(key), F.window(F.col(at), f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("hits"))
    return counted.filter(F.col("hits") > limit).select(key, F.col("w.start").alias("window_start"), "hits")


def unread(notifications: DataFrame, owner: str, read: Column) -> DataFrame:
    """A running count for each owner (update or complete mode)."""
    return notifications.groupBy(owner).agg(F.count_if(~read).alias("unread"))


def latest(events: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    return events.groupBy(key).agg(F.max(at).alias(at), *[F.max_by(c, at).alias(c) for c in columns])


def attempts(events: DataFrame, key: str, key_type: str, at: str, failed: Column, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """A row for a key whenever a batch moves it: login_attempts, status, blocked_at.

    State is the counter and the time of the block, kept for ever (``timers.attempts``
    forgets keys without open failures). Events of one batch are
    taken in time order; an event older than the last batch counts when it comes.
    """

    def step(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, blocked = state.get if state.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values("at")
        for when, bad in zip(rows["at"], rows["bad"], strict=True):
            if blocked is not None:
                break
            n = n + 1 if bad else 0
            if n >= limit:
                blocked = when.to_pydatetime()
        state.update((n, blocked))
        yield pd.DataFrame({"key": [group[0]], "login_attempts": [n], "status": ["BLOCKED" if blocked is not None else "ACTIVE"], "blocked_at": pd.to_datetime([blocked])})

    rows = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), failed.cast("boolean").alias("bad"))
    out = f"key {key_type}, login_attempts bigint, status string, blocked_at timestamp"
    return rows.groupBy("key").applyInPandasWithState(step, out, "n bigint, blocked timestamp", "update", GroupStateTimeout.NoTimeout).withColumnRenamed("key", key)


def codes(issued: DataFrame, verified: DataFrame, late: str = "30 minutes", minutes: int = 10) -> DataFrame:
    """Verifications that meet an issued code of their user within its life (user_id, code, at on both sides): an interval join."""
    a = issued.withWatermark("at", late).alias("a")
    b = verified.withWatermark("at", late).alias("b")
    on = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.code") == F.col("b.code")) & (F.col("b.at") >= F.col("a.at")) & (F.col("b.at") <= F.col("a.at") + F.expr(f"interval {minutes} minutes"))
    return a.join(b, on).select(F.col("a.user_id").alias("user_id"), F.col("a.at").alias("issued_at"), F.col("b.at").alias("verified_at"))
