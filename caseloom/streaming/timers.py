"""Streams whose state ends by itself: attempts, windows from the first request, sessions, one-time codes.

Each is a ``transformWithState`` operator by key in event time.  Rows wait in the
key's state until the watermark has passed them and are then taken in time order,
so a stream gives what the batch operator gives, whatever the order of arrival
within ``late``; later rows are dropped.  Timers end what ends: a window, a
session, a code, a block.  What holds nothing any more is deleted, so state holds
keys with something open, not all that were ever seen.

The session needs ``spark.sql.streaming.stateStore.providerClass`` set to Spark's
RocksDB provider, which timers require; ``ROCKSDB`` has its name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from caseloom.operators.state import CODE_MINUTES, MAX_ATTEMPTS, WINDOW_LIMIT, WINDOW_MINUTES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MINUTE = 60_000_000


class InOrder(StatefulProcessor):
    """Rows (key, at in microseconds, rank, body as JSON) in the order of at, rank and body; ``state`` is a JSON object or None."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint", "rows array<string>")
        self.kept = handle.getValueState("kept", "json string")

    def take(self, state: dict | None, at: int, body: dict) -> tuple[dict | None, list[dict]]:
        """The state after an event, and what it tells."""
        raise NotImplementedError

    def end(self, state: dict | None) -> int | None:
        """When the state ends by itself, in microseconds."""
        return None

    def ended(self, state: dict) -> tuple[dict | None, list[dict]]:
        """The state after its end, and what that tells."""
        return None, []

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new: dict[int, list[str]] = {}
        for r in rows:
            new.setdefault(r.at, []).append(f"{r.rank:03d}{r.body}")
        for at, bodies in new.items():
            had = self.waiting.getValue((at,))[0] if self.waiting.containsKey((at,)) else []
            self.waiting.updateValue((at,), ([*had, *bodies],))
            # due when the watermark has passed it: timers are in milliseconds
            self.handle.registerTimer(at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else None
        before, told = state, []
        due = sorted(at for (at,) in self.waiting.keys() if at < now)
        for at in [*due, None]:
            while (end := self.end(state)) is not None and end <= (now if at is None else at):
                state, said = self.ended(state)
                told += said
            if at is not None:
                for body in sorted(self.waiting.getValue((at,))[0]):
                    state, said = self.take(state, at, json.loads(body[3:]))
                    told += said
                self.waiting.removeKey((at,))
        if state is None:
            self.kept.clear()
        elif state != before:
            self.kept.update((json.dumps(state),))
        if (end := self.end(state)) is not None:
            self.handle.registerTimer(end // 1000 + 1)
        for x in self.latest(told):
            yield Row(key=key[0], **x)

    def latest(self, told: list[dict]) -> list[dict]:
        return told

    def close(self) -> None:
        pass


def _run(events: DataFrame, key: Column, at: Column, rank: Column, body: Column, late: str, processor: InOrder, out: str, mode: str) -> DataFrame:
    ts = at.cast("timestamp")
    rows = events.select(key.alias("key"), ts.alias("ts"), F.unix_micros(ts).alias("at"), rank.cast("int").alias("rank"), F.to_json(body).alias("body")).filter("at is not null")
    kind = dict(rows.dtypes)["key"]
    return rows.withWatermark("ts", late).groupBy("key").transformWithState(processor, f"key {kind}, {out}", mode, "EventTime")


class _Attempts(InOrder):
    def __init__(self, limit: int, hold: int | None):
        self.limit, self.hold = limit, hold

    def take(self, state, at, body):
        s = state or {"n": 0, "at": None}
        if s["at"] is None:
            n = s["n"] + 1 if body["bad"] else 0
            s = {"n": n, "at": at if n >= self.limit else None}
        row = {"login_attempts": s["n"], "status": "ACTIVE" if s["at"] is None else "BLOCKED", "blocked_us": s["at"]}
        return (s if s["n"] else None), [row]

    def end(self, state):
        return state["at"] + self.hold if state and state["at"] is not None and self.hold is not None else None

    def latest(self, told):
        return told[-1:]


def attempts(events: DataFrame, key: str, at: str, failed: Column, late: str = "30 minutes", limit: int = MAX_ATTEMPTS, hold_minutes: int | None = None) -> DataFrame:
    """A row for a key whenever its events are taken: login_attempts, status, blocked_at (update mode).

    State is kept for keys with failures that no success has reset, and for
    blocked ones: for ever, or ``hold_minutes`` (then a key may try anew).
    """
    got = _run(events, F.col(key), F.col(at), F.when(failed, 0).otherwise(1), F.struct(F.coalesce(failed, F.lit(False)).alias("bad")), late, _Attempts(limit, None if hold_minutes is None else hold_minutes * _MINUTE), "login_attempts bigint, status string, blocked_us bigint", "Update")
    return got.select(F.col("key").alias(key), "login_attempts", "status", F.timestamp_micros("blocked_us").alias("blocked_at"))


class _Windows(InOrder):
    def __init__(self, width: int, limit: int):
        self.width, self.limit = width, limit

    def take(self, state, at, body):
        return {"at": state["at"] if state else at, "n": (state["n"] if state else 0) + 1}, []

    def end(self, state):
        return state["at"] + self.width if state else None

    def ended(self, state):
        return None, [{"start_us": state["at"], "hits": state["n"]}] if state["n"] > self.limit else []


def over_limit_from_first(events: DataFrame, key: str, at: str, late: str = "30 minutes", minutes: int = WINDOW_MINUTES, limit: int = WINDOW_LIMIT) -> DataFrame:
    """As the batch operator; a window is told once the watermark has passed its end, and then forgotten (append mode)."""
    got = _run(events, F.col(key), F.col(at), F.lit(0), F.struct(F.lit(1).alias("n")), late, _Windows(minutes * _MINUTE, limit), "start_us bigint, hits bigint", "Append")
    return got.select(F.col("key").alias(key), F.timestamp_micros("start_us").alias("window_start"), "hits")


class _Sessions(InOrder):
    def __init__(self, keep: int):
        self.keep = keep

    def take(self, state, at, body):
        s = state or {"user_id": None, "login": None, "hash": None, "expires": None, "logout": None, "told": False}
        kind = body["kind"]
        if kind == "revoke":
            s = s | {"logout": at}
        elif s["logout"] is None or s["logout"] == at:
            s = s | {"hash": body.get("token_hash"), "expires": body["expires"], "told": False}
        if kind == "create":
            s = s | {"user_id": body.get("user_id"), "login": at if s["login"] is None else s["login"]}
        return s, [self._row(s, at)] if s["login"] is not None else []

    @staticmethod
    def _row(s, at):
        state = "REVOKED" if s["logout"] is not None else "ACTIVE" if s["expires"] > at else "EXPIRED"
        return {"user_id": s["user_id"], "login_us": s["login"], "token_hash": s["hash"], "expires_us": s["expires"], "logout_us": s["logout"], "state": state}

    def end(self, state):
        if state is None:
            return None
        if state["logout"] is None and state["expires"] is not None and not state["told"]:
            return state["expires"]
        return max(x for x in (state["logout"], state["expires"]) if x is not None) + self.keep

    def ended(self, state):
        if state["logout"] is None and state["expires"] is not None and not state["told"]:
            state = state | {"told": True}
            return state, [self._row(state, state["expires"])] if state["login"] is not None else []
        return None, []

    def latest(self, told):
        return told[-1:]


def sessions(events: DataFrame, late: str = "30 minutes", keep_minutes: int = 1440) -> DataFrame:
    """A row for a session whenever it changes or its time is up: its state ACTIVE, EXPIRED or REVOKED (update mode).

    Events are those of the batch operator (session_id, user_id, kind, token_hash,
    expires_at, at).  A session is forgotten ``keep_minutes`` after its end; until
    then a revocation still counts.
    """
    rank = F.when(F.col("kind") == "create", 0).when(F.col("kind") == "rotate", 1).otherwise(2)
    body = F.struct("kind", "user_id", "token_hash", F.unix_micros(F.col("expires_at").cast("timestamp")).alias("expires"))
    out = "user_id string, login_us bigint, token_hash string, expires_us bigint, logout_us bigint, state string"
    got = _run(events.filter(F.col("kind").isin("create", "rotate", "revoke") & ((F.col("kind") == "revoke") | F.col("expires_at").isNotNull())).withColumn("user_id", F.col("user_id").cast("string")), F.col("session_id"), F.col("at"), rank, body, late, _Sessions(keep_minutes * _MINUTE), out, "Update")
    return got.select(F.col("key").alias("session_id"), "user_id", F.timestamp_micros("login_us").alias("login_time"), "token_hash", F.timestamp_micros("expires_us").alias("expires_at"), F.timestamp_micros("logout_us").alias("logout_time"), "state")


class _Codes(InOrder):
    def __init__(self, life: int):
        self.life = life

    def take(self, state, at, body):
        if body["kind"] == "issue":
            return {"code": body["code"], "at": at}, []
        # a code past its end is gone, with its timer, unless the verification stands at its very end
        row = {"at_us": at, "state": "NONE" if state is None else "VALID" if body.get("code") == state["code"] else "WRONG"}
        return (None if row["state"] == "VALID" else state), [row]

    def end(self, state):
        return state["at"] + self.life + 1 if state else None


def code_checks(events: DataFrame, late: str = "30 minutes", minutes: int = CODE_MINUTES) -> DataFrame:
    """Each verification against its user's newest code (events: user_id, kind issue or verify, code, at), in append mode.

    VALID uses the code up; WRONG leaves it; NONE: no code is alive, for none was
    issued, or it is used up or past its ``minutes``.  Only live codes are state.
    """
    rank = F.when(F.col("kind") == "issue", 0).otherwise(1)
    got = _run(events.filter(F.col("kind").isin("issue", "verify")), F.col("user_id"), F.col("at"), rank, F.struct("kind", "code"), late, _Codes(minutes * _MINUTE), "at_us bigint, state string", "Append")
    return got.select(F.col("key").alias("user_id"), F.timestamp_micros("at_us").alias("at"), "state")
