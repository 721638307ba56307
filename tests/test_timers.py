"""Stateful streams against the batch operators, whatever the order of arrival; state shrinks."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from caseloom.operators import state
from caseloom.streaming import timers

BASE = dt.datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(key, None)
    spark.conf.set(key, timers.ROCKSDB)
    yield spark
    spark.conf.set(key, had) if had else spark.conf.unset(key)


def fed(spark, tmp_path, rows, ddl, end, files=3):
    """Rows in files of one batch each, the last of which moves the watermark past all."""
    path = str(tmp_path / uuid.uuid4().hex)
    cut = [rows[len(rows) * i // files : len(rows) * (i + 1) // files] for i in range(files)] + [end]
    for i, part in enumerate(cut):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return lambda: spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def run(spark, df, mode):
    name = f"t_{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()
    return spark.table(name), held


def shuffled(rng, rows, minutes=20):
    """Arrival up to some minutes late."""
    return sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.random() * minutes))


def test_attempts(rocks, tmp_path):
    rng = random.Random(1)
    rows = [(f"u{i % 7}", BASE + dt.timedelta(minutes=rng.randint(0, 400)), rng.random() < 0.35) for i in range(300)]
    rows = shuffled(rng, list({(k, t): (k, t, b) for k, t, b in rows}.values()))
    end = [("zz", BASE + dt.timedelta(days=9), False)]
    live = fed(rocks, tmp_path, rows, "user_id string, ts timestamp, bad boolean", end)()
    got, held = run(rocks, timers.attempts(live, "user_id", "ts", F.col("bad")), "update")
    last = {}
    for r in got.collect():
        last[r.user_id] = tuple(r)
    batch = rocks.createDataFrame(rows, "user_id string, ts timestamp, bad boolean")
    assert set(last.values()) - {last.get("zz")} == {tuple(r) for r in state.attempts(batch, "user_id", "ts", F.col("bad")).collect()}
    assert held[-1] < max(held)
    again, held = run(rocks, timers.attempts(fed(rocks, tmp_path, rows, "user_id string, ts timestamp, bad boolean", end)(), "user_id", "ts", F.col("bad"), hold_minutes=60), "update")
    assert {r.user_id for r in again.collect()} >= {f"u{i}" for i in range(7)}


def test_windows_from_the_first_request(rocks, tmp_path):
    rng = random.Random(2)
    rows = shuffled(rng, [(f"c{rng.randrange(4)}", BASE + dt.timedelta(seconds=rng.randint(0, 20_000))) for _ in range(400)])
    ddl = "client string, at timestamp"
    got, held = run(rocks, timers.over_limit_from_first(fed(rocks, tmp_path, rows, ddl, [("zz", BASE + dt.timedelta(days=9))])(), "client", "at", limit=2), "append")
    want = {tuple(r) for r in state.over_limit_from_first(rocks.createDataFrame(rows, ddl), "client", "at", limit=2).collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20
    assert held[-1] <= 2 < max(held)


def test_sessions(rocks, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        t = BASE + dt.timedelta(minutes=rng.randint(0, 300))
        rows.append((f"s{i}", t, f"u{i % 5}", "create", f"h{i}", t + dt.timedelta(minutes=60)))
        for k in range(rng.randint(0, 3)):
            t += dt.timedelta(minutes=rng.randint(1, 40))
            rows.append((f"s{i}", t, f"u{i % 5}", "rotate", f"h{i}.{k}", t + dt.timedelta(minutes=60)))
        if i % 3 == 0:
            rows.append((f"s{i}", t + dt.timedelta(minutes=rng.randint(1, 90)), None, "revoke", None, None))
    ddl = "session_id string, at timestamp, user_id string, kind string, token_hash string, expires_at timestamp"
    rows = shuffled(rng, rows)
    end = BASE + dt.timedelta(days=9)
    got, held = run(rocks, timers.sessions(fed(rocks, tmp_path, rows, ddl, [("zz", end, "z", "create", "h", end)])()), "update")
    last = {r.session_id: r.asDict() for r in got.collect()}
    last.pop("zz", None)
    want = {r.session_id: r.asDict() for r in state.sessions(rocks.createDataFrame(rows, ddl), F.lit(end)).collect()}
    assert last == want and {r["state"] for r in want.values()} == {"EXPIRED", "REVOKED"}
    assert held[-1] <= 4 < max(held)


def test_codes(rocks, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        kind = rng.choice(("issue", "verify", "verify"))
        rows.append((f"u{rng.randrange(3)}", BASE + dt.timedelta(minutes=rng.randint(0, 300), microseconds=i), kind, str(rng.randrange(2))))
    want, now = [], {}
    for u, t, kind, code in sorted(rows, key=lambda r: r[1]):
        if kind == "issue":
            now[u] = (code, t)
        else:
            have = now.get(u)
            live = have is not None and t <= have[1] + dt.timedelta(minutes=10)
            want.append((u, t, "NONE" if not live else "VALID" if code == have[0] else "WRONG"))
            if want[-1][2] == "VALID":
                del now[u]
    ddl = "user_id string, at timestamp, kind string, code string"
    got, held = run(rocks, timers.code_checks(fed(rocks, tmp_path, shuffled(rng, rows), ddl, [("zz", BASE + dt.timedelta(days=9), "issue", "1")])()), "append")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and {w[2] for w in want} == {"NONE", "VALID", "WRONG"}
    assert held[-1] <= 2 < max(held)
