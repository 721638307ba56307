"""Attempt counters, one-time codes, sessions and rate limits over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators import chunks
from caseloom.sources.shared import settled

# Limits of the state machines.
MAX_ATTEMPTS = 3
CODE_MINUTES = 10
RESET_MINUTES = 15
WINDOW_MINUTES = 15
WINDOW_LIMIT = 100


def attempts(events: DataFrame, key: str, at: str, failed: Column, limit: int = MAX_ATTEMPTS, tie: str | None = None) -> DataFrame:
    """One row for each key: login_attempts, status, blocked_at after all its events.

    A success resets the counter; the ``limit``-th failure in a row blocks, and
    what follows a block changes nothing.  Events of one time are taken by
    ``tie``, or failures first; an event without a time is none.  Events are
    dealt by ranges of key and time, so a hot key's history is read by many tasks,
    and each key's answer is a fold over what its partitions say.
    """
    bad = F.coalesce(failed, F.lit(False)).cast("boolean").alias("bad")
    rows = events.filter(F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), bad, *([F.col(tie).alias("tie")] if tie else []))
    kind = dict(rows.dtypes)
    ordered = chunks.ranges(rows, F.col("key"), F.col("at"), F.col("tie") if tie else F.desc("bad")).select("key", "at", "bad")
    done = chunks.folded(chunks.attempt_pieces(ordered, limit, kind["key"], kind["at"]), limit)
    blocked = F.col("blocked_at").isNotNull()
    return done.select(F.col("key").alias(key), F.when(blocked, F.lit(limit)).otherwise(F.col("n")).cast("bigint").alias("login_attempts"), F.when(blocked, "BLOCKED").otherwise("ACTIVE").alias("status"), "blocked_at")


def code_state(code: Column, given: Column, expires_at: Column, as_of: Column) -> Column:
    """VALID, EXPIRED or WRONG; a null fails."""
    same = F.coalesce(code == given, F.lit(False))
    live = F.coalesce(expires_at >= as_of, F.lit(False))
    return F.when(~same, "WRONG").when(~live, "EXPIRED").otherwise("VALID")


def may_reset(verified_at: Column, as_of: Column, minutes: int = RESET_MINUTES) -> Column:
    return F.coalesce(verified_at + F.make_dt_interval(mins=F.lit(minutes)) >= as_of, F.lit(False))


def gate(status: Column) -> Column:
    return F.when(status == "BLOCKED", "REJECT_BLOCKED").when(status == "INACTIVE", "REJECT_INACTIVE").otherwise("PASS")


def over_limit(events: DataFrame, key: str, at: str, minutes: int = WINDOW_MINUTES, limit: int = WINDOW_LIMIT) -> DataFrame:
    """Aligned windows in which a key has more than ``limit`` events; counts combine before the shuffle."""
    w = F.window(F.col(at), f"{minutes} minutes")
    counted = events.groupBy(F.col(key), w.alias("w")).agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") > limit)
    return counted.select(key, F.col("w.start").alias("window_start"), "hits")


def over_limit_from_first(events: DataFrame, key: str, at: str, minutes: int = WINDOW_MINUTES, limit: int = WINDOW_LIMIT) -> DataFrame:
    """Windows that begin with a key's first event, the next one with its first event after that window, in which it has more than ``limit``.

    Where a window begins depends on the one before.  Equal times are counted
    first; times are then dealt by ranges of key and time, each partition says how
    a window that is open before it leaves it, a fold over these tells each
    partition its open window, and all read their windows at once.
    """
    kind, key_type, width = dict(events.dtypes)[at], dict(events.dtypes)[key], minutes * 60_000_000
    counted = events.filter(F.col(at).isNotNull()).groupBy(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    ordered = settled(chunks.ranges(counted, F.col("key"), F.col("at")))
    entry = chunks.entries(chunks.edge_steps(ordered, width, key_type))
    got = chunks.window_hits(ordered, entry, width, limit, key_type)
    whole = got.groupBy("key", "at").agg(F.sum("hits").alias("hits")).filter(F.col("hits") > limit)
    return whole.select(F.col("key").alias(key), F.timestamp_micros("at").cast(kind).alias("window_start"), "hits")


def latest(events: DataFrame, key: str, at: str, *columns: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key, by one aggregate; of rows of one time the one with the highest ``tie``, or the highest values."""
    by = F.struct(F.col(at), F.col(tie)) if tie else F.struct(F.col(at), *[F.col(c) for c in columns])
    return events.groupBy(key).agg(F.max(at).alias(at), *[F.max_by(c, by).alias(c) for c in columns])


def sessions(events: DataFrame, as_of: Column) -> DataFrame:
    """Sessions from their events (session_id, user_id, kind, token_hash, expires_at, at): created, rotated, revoked.

    A rotation replaces hash and expiry unless the session is revoked by then; a
    second revocation moves logout_time.  ``state`` is ACTIVE, EXPIRED or REVOKED
    at as_of; sessions that were never created are left out.
    """
    revoked = F.min(F.when(F.col("kind") == "revoke", F.col("at"))).over(Window.partitionBy("session_id"))
    counts = F.col("kind").isin("create", "rotate") & (F.col("_revoked").isNull() | (F.col("at") <= F.col("_revoked")))
    by = F.when(counts, F.struct("at", F.col("kind") == "rotate", "token_hash"))
    one = events.withColumn("_revoked", revoked).groupBy("session_id").agg(
        F.max_by("user_id", F.when(F.col("kind") == "create", F.col("at"))).alias("user_id"),
        F.min(F.when(F.col("kind") == "create", F.col("at"))).alias("login_time"),
        F.max_by("token_hash", by).alias("token_hash"), F.max_by("expires_at", by).alias("expires_at"),
        F.max(F.when(F.col("kind") == "revoke", F.col("at"))).alias("logout_time"),
    )
    state = F.when(F.col("logout_time").isNotNull(), "REVOKED").when(F.col("expires_at") > as_of, "ACTIVE").otherwise("EXPIRED")
    return one.filter(F.col("login_time").isNotNull()).withColumn("state", state)


def due_doses(medications: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """Doses whose reminder falls into the ``minutes`` from as_of on: (id, user_id, time, due_at). An extension: only its columns are given.

    A reminder stands reminder_before_minutes before a time of day; rows that
    are deleted, without reminders, not begun or ended have none.
    """
    day = as_of.cast("date")
    begun = (F.col("start_date") <= F.date_add(day, 1)) & (F.coalesce(F.col("ongoing"), F.lit(False)) | F.col("end_date").isNull() | (F.col("end_date") >= day))
    live = medications.filter(~F.col("soft_delete") & F.coalesce(F.col("dose_reminders"), F.lit(False)) & begun)
    slot = live.select("id", "user_id", "start_date", "end_date", "ongoing", "reminder_before_minutes", F.explode("medication_times").alias("t"))
    # of today or of tomorrow: a reminder before midnight may be for a dose after it
    slot = slot.select("*", F.explode(F.array(day, F.date_add(day, 1))).alias("day"))
    clock = F.split(F.col("t.time"), ":")
    hour = F.get(clock, F.lit(0)).try_cast("int") % 12 + F.when(F.upper(F.col("t.period")) == "PM", 12).otherwise(0)
    due = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=hour, mins=F.get(clock, F.lit(1)).try_cast("int"))
    slot = slot.withColumn("due_at", due).withColumn("_at", F.col("due_at") - F.make_dt_interval(mins=F.col("reminder_before_minutes")))
    inside = (F.col("_at") >= as_of) & (F.col("_at") < as_of + F.make_dt_interval(mins=F.lit(minutes)))
    ends = F.coalesce(F.col("ongoing"), F.lit(False)) | F.col("end_date").isNull() | (F.col("day") <= F.col("end_date"))
    return slot.filter(inside & ends & (F.col("day") >= F.col("start_date"))).select("id", "user_id", F.col("t.time").alias("time"), "due_at")


def refills(medications: DataFrame, days: int = 3) -> DataFrame:
    """Prescriptions to refill: alerts on, not deleted, and no more left than ``days`` take. An extension, as above."""
    short = F.col("remaining_quantity") <= F.col("daily_consumption") * days
    return medications.filter(~F.col("soft_delete") & F.coalesce(F.col("refill_alert"), F.lit(False)) & short).select("id", "user_id", "remaining_quantity")


def unread(notifications: DataFrame, owner: str, read: Column) -> DataFrame:
    return notifications.groupBy(owner).agg(F.count_if(~read).alias("unread"))


def ocr_status(started: Column, succeeded: Column) -> Column:
    """pending, in_progress, then completed; a failure is said as such."""
    return F.when(~started, "pending").when(succeeded.isNull(), "in_progress").when(succeeded, "completed").otherwise("failed")
