"""Substring deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest

from caseloom.llm import suffix
from tests.llm.util import docs_frame, rows_of


def brute(rows, length=suffix.LENGTH):
    rows = sorted((d if d is not None else -(2**63), (t or "").encode()) for d, t in rows)
    seen, out = set(), []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d if d != -(2**63) else None, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(base)[rng.randint(0, 40) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 4))]
        rows.append((i, " ".join(parts)))
    rows += [(100, "ab" * 400), (101, "x" * 1500 + "ab" * 90), (102, None), (103, ""), (104, "x" * 99), (105, "x" * 100), (None, base[0]), (7, base[1]), (7, base[1]), (7, "short")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [2048, 1])
def test_matches_brute_force(spark, hot):
    rows = corpus(hot)
    got = rows_of(suffix.substring_dedup(docs_frame(spark, rows), hot_units=hot))
    assert got == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert rows_of(suffix.substring_dedup(docs_frame(spark, []))) == []
    df = spark.createDataFrame([(1, "a" * 250, 5, "k")], "doc_id long, text string, shard int, blob string")
    assert rows_of(suffix.substring_dedup(df)) == brute([(1, "a" * 250)])


def test_kept_text_is_what_is_left(spark):
    rows = [(1, "p" * 10 + "".join(map(str, range(200)))), (2, "".join(map(str, range(200))) + "tail")]
    got = {r.doc_id: r for r in suffix.substring_dedup(docs_frame(spark, rows), with_text=True).collect()}
    assert bytes(got[2].kept) == b"tail" and bytes(got[1].kept).decode() == rows[0][1]


def common(t, i, j):
    k = 0
    while i + k < len(t) and j + k < len(t) and t[j + k] == t[i + k]:
        k += 1
    return k


def test_longest_previous_factor_arrays():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 30, 200, 400):
        t = rng.integers(0, 3 if n < 400 else 1, n).tolist()
        sa = np.array(sorted(range(n), key=lambda i: t[i:]), np.int64)
        lcp = np.array([common(t, sa[i - 1], sa[i]) if i else 0 for i in range(n)], np.int64)
        assert suffix.lpf(sa, lcp).tolist() == [max([0, *(common(t, i, j) for j in range(i))]) for i in range(n)]


def test_common_prefixes_and_repeats_of_starts():
    rng = np.random.default_rng(4)
    codes = np.concatenate([rng.integers(0, 2, 700), np.zeros(300), rng.integers(0, 2, 50), np.ones(20)]).astype(np.uint8)
    t = codes.tolist()
    for length in (8, 13, 24, 100):
        starts = np.arange(len(codes) - length + 1)
        a, b = rng.choice(starts, 300), rng.choice(starts, 300)
        assert suffix.common_prefix(codes, a, b, length).tolist() == [min(length, common(t, i, j)) for i, j in zip(a, b, strict=True)]
        some = np.sort(rng.choice(starts, min(250, len(starts)), replace=False))
        got = suffix.repeats(codes, some, length)
        assert got.tolist() == [any(t[i : i + length] == t[j : j + length] for j in some[:k]) for k, i in enumerate(some)]
