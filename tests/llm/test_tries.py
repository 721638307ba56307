"""Conversation tries against a dictionary of all prefixes."""

import hashlib
import math
import random
import zlib

import pytest

from caseloom.llm import tries

DDL = "conv_id long, turn long, role string, text string"


def plain(rows, rebuild=True):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by.setdefault(c, []).append(((t is not None, t or 0), r, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), x))
    by = {c: [(r, x) for _, r, _, x in sorted(turns)] for c, turns in by.items()}
    seq = {}
    for c in by:
        h = zlib.crc32(str(c).encode()) % 9
        seq[c] = tuple(by.get(c - int(math.fmod(c, 5)), [])[:h] + by[c][h:]) if rebuild else tuple(by[c])
    nodes, kids, below = {}, {}, {}
    for c, s in seq.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        mine = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[k][0] for k in kids.get(p, [])) or 1, mine + sum(below[k][1] for k in kids.get(p, [])))
    return sorted(
        (
            (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *below[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seq[c]) == len(p)).encode()).hexdigest())
            for p, m in nodes.items()
        ),
        key=str,
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*tries.COLUMNS).collect()), key=str)


def test_odd_rows(spark):
    rows = [(0, None, "user", "a"), (0, 0, None, None), (0, 0, "user", "é"), (0, 0, "user", "é"), (1, 0, "user", "a"), (2, 5, "x", ""), (-3, 1, "user", "a"), (None, 0, "user", "lost"), (7, 0, "us", "era"), (7, 0, "use", "ra")]
    rows += [(c, t, "user", "same") for c in range(20, 60) for t in range(12)]
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "1 as depth", "'x' as packed", "2 as n_convs").repartition(3)
    assert rows_of(tries.conversation_trie(df)) == plain(rows)
    assert rows_of(tries.conversation_trie(spark.createDataFrame([], DDL))) == []
    assert rows_of(tries.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], DDL))) == []


@pytest.mark.parametrize("limit", [1, 3, 256])
def test_bursting_changes_nothing(spark, limit):
    """Deep common prefixes, every prefix of a trunk, copies, entries that end at heads."""
    rng = random.Random(limit)
    rows = [(c, t, "user", f"trunk {t}") for c in range(40) for t in range(c)]
    rows += [(100 + c, t, "user", f"trunk {t}" if t < 30 else f"{c % 7} {t}") for c in range(40) for t in range(33)]
    rows += [(200 + c, t, rng.choice("ab"), rng.choice("xy")) for c in range(60) for t in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, DDL).repartition(5)
    assert rows_of(tries.trie(tries.sequences(df), limit)) == plain(rows, rebuild=False)
    assert rows_of(tries.trie(tries.rebuilt(df), limit)) == plain(rows)


def test_copies_meet_as_chunks(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 50)
    rows = [(c, t, "user", f"hello {t}") for c in range(0, 2500, 5) for t in range(2)]
    df = spark.createDataFrame(rows, DDL).repartition(4)
    assert rows_of(tries.conversation_trie(df)) == plain(rows)


def test_heads_are_few(spark):
    rows = [(c, t, "user", f"{c % 3}" if t == 0 else f"{c} {t}") for c in range(60) for t in range(3)]
    kept = tries.entries(tries.sequences(spark.createDataFrame(rows, DDL)))
    assert sorted((d, n) for _, _, d, n in tries.heads_of(kept, 10)) == [(0, 0), (1, 1), (1, 1), (1, 1)]
    assert len(tries.heads_of(kept, 20)) == 1
