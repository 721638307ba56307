"""State machines split over a hot key, against plain loops."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import chunks, state

BASE = datetime(2024, 1, 1)


@pytest.fixture(params=[1, 8, 23])
def parts(spark, request):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", had)


def plain_attempts(rows, limit):
    by, out = defaultdict(list), {}
    for k, at, bad in rows:
        by[k].append((at, not bad, bad))
    for k, events in by.items():
        n, blocked = 0, None
        for at, _, bad in sorted(events):
            n = n + 1 if bad else 0
            if n >= limit:
                blocked = at
                break
        out[k] = (n, "BLOCKED" if blocked else "ACTIVE", blocked)
    return out


@pytest.mark.parametrize("limit", [1, 3, 5])
def test_attempts_of_hot_keys(spark, parts, limit):
    rng = random.Random(limit)
    rows = []
    for k, n in [("hot", 3000), ("quiet", 2500), (None, 40), *((f"k{i}", rng.randint(1, 9)) for i in range(60))]:
        share = 0.02 if k == "quiet" else 0.3
        rows += [(k, BASE + timedelta(seconds=rng.randint(0, 4 * n)), rng.random() < share) for _ in range(n)]
    rows += [("late", BASE + timedelta(seconds=i), i >= 998) for i in range(1000 + limit - 3 if limit > 2 else 999)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, bad boolean").repartition(7)
    got = {r.k: (r.login_attempts, r.status, r.blocked_at) for r in state.attempts(df, "k", "at", F.col("bad"), limit).collect()}
    assert got == plain_attempts(rows, limit)


def test_pieces_compose():
    """Any cut of a history gives the same map."""
    rng = random.Random(1)
    for _ in range(200):
        n, limit = rng.randint(2, 30), rng.randint(1, 4)
        at, bad = np.arange(n), np.array([rng.random() < 0.6 for _ in range(n)])
        (whole,) = chunks.pieces(at, bad, np.array([0, n]), limit)
        cut = sorted({0, n, *(rng.randrange(1, n) for _ in range(3))})
        many = chunks.pieces(at, bad, np.array(cut), limit)
        one = many[0]
        for x in many[1:]:
            one = chunks.joined(one, x, limit)
        assert one == whole


def plain_windows(rows, width, limit):
    by, out = defaultdict(list), []
    for k, at in rows:
        by[k].append(at)
    for k, ts in by.items():
        begin = hits = None
        for at in sorted(ts):
            if begin is None or at >= begin + width:
                if begin is not None and hits > limit:
                    out.append((k, begin, hits))
                begin, hits = at, 0
            hits += 1
        if hits > limit:
            out.append((k, begin, hits))
    return sorted(out, key=str)


def test_windows_of_hot_keys(spark, parts):
    rng = random.Random(8)
    rows = []
    for k, n, span in [("dense", 4000, 3_000), ("long", 3000, 900_000), ("even", 0, 0), (None, 300, 9_000), *((f"k{i}", rng.randint(1, 6), 5_000) for i in range(50))]:
        rows += [(k, BASE + timedelta(seconds=rng.randint(0, span), microseconds=rng.choice((0, 1)))) for _ in range(n)]
    rows += [("even", BASE + timedelta(minutes=i)) for i in range(2000)] + [("same", BASE)] * 2000
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz").repartition(6)
    for limit in (0, 3, 14):
        got = sorted((tuple(r) for r in state.over_limit_from_first(df, "k", "at", limit=limit).collect()), key=str)
        assert got == plain_windows(rows, timedelta(minutes=15), limit)


def test_steps_are_those_of_a_plain_chain():
    rng = np.random.default_rng(2)
    for _ in range(100):
        t = np.unique(rng.integers(0, rng.integers(5, 500), rng.integers(1, 60)))
        width = int(rng.integers(1, 80))
        latest, exits = chunks.steps(t, width)
        for entry in [None, *range(int(t[0]) - 3, int(t[0]) + width + 1)]:
            end = entry
            for x in t.tolist():
                if end is None or x >= end:
                    end = x + width
            assert chunks.through(entry, latest, exits) == end


def test_a_million_events_of_one_user_are_read_by_many_tasks(spark):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(1_000_000).select(F.lit("u").alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("at"), (F.pmod(F.xxhash64("id"), F.lit(100)) < 20).alias("bad"))
        ordered = chunks.ranges(rows, F.col("k"), F.col("at"))
        size = sorted(r["count"] for r in ordered.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert len(size) >= 8 and size[-1] < 250_000
        one = state.attempts(rows, "k", "at", F.col("bad"), 7).collect()
        bad = (rows.select("bad").toPandas()["bad"]).to_numpy()
        streak = np.arange(len(bad)) - np.maximum.accumulate(np.where(~bad, np.arange(len(bad)), -1))
        first = np.flatnonzero(streak >= 7)
        assert len(one) == 1 and (one[0].status == "BLOCKED") == (len(first) > 0)
        if len(first):
            assert one[0].blocked_at.timestamp() == 1_700_000_000 + int(first[0])
        got = state.over_limit_from_first(rows, "k", "at", limit=899).collect()
        assert len(got) == 1_000_000 // 900 and {r.hits for r in got} == {900}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
