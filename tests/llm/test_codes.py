"""Lloyd rounds over residents against plain ones in whole numbers of any size."""

import hashlib
import math
import random

import numpy as np
import pytest

from caseloom.llm import codes

DDL = "vec_id long, embedding array<double>, label int"


def plain(rows, rounds=2, entries=64):
    kept = []
    for v, x, label in rows:
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            bound = math.isqrt(2**62 // max(len(x), 1)) // 2
            kept.append((v, [max(-bound, min(bound, math.floor(256 * c))) for c in x], label))
    out = []
    for dim in {len(x) for _, x, _ in kept}:
        mine = [r for r in kept if len(r[1]) == dim]
        first = sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
        cut = [i * dim // 16 for i in range(17)]
        books = [[r[1][a:b] for r in first] for a, b in zip(cut, cut[1:])]
        gap = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))

        def assign():
            return [[min((gap(r[1][cut[p] : cut[p + 1]], e), i) for i, e in enumerate(books[p])) for p in range(16)] for r in mine]

        for _ in range(rounds):
            near = assign()
            for p in range(16):
                for e in range(len(books[p])):
                    of = [r[1][cut[p] : cut[p + 1]] for r, a in zip(mine, near) if a[p][1] == e]
                    if of:
                        books[p][e] = [sum(c) // len(of) for c in zip(*of)]
        sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        out += [(r[0], "".join(f"{i:02x}" for _, i in a), sum(d for d, _ in a), r[2], sha) for r, a in zip(mine, assign())]
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((v, c, e, total[label], sha) for v, c, e, label, sha in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("label").collect()), key=str)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(200 + i, [0.25] * 32, 7) for i in range(80)]  # a hot vector and label
    rows += [(3, [0.5] * 32, 1), (None, [0.1] * 32, None), (300, None, 1), (301, [math.nan] * 32, 1), (302, [math.inf] + [0.0] * 31, 1), (303, [None] + [0.0] * 31, 1)]
    rows += [(400, [], 1), (401, [1.5, -2.5], 1), (402, [0.1] * 19, 2), (403, [1e9] * 32, 1), (404, [-1e300] * 32, 1)]
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "'x' as code", "1 as error", "2 as dim", "3 as row").repartition(5)
    assert rows_of(codes.vector_codes(df)) == plain(rows)
    assert rows_of(codes.vector_codes(df, rounds=3, entries=5)) == plain(rows, 3, 5)
    assert rows_of(codes.vector_codes(df, rounds=0)) == plain(rows, 0)
    empty = codes.vector_codes(spark.createDataFrame([(1, None, 1)], DDL))
    assert empty.columns == codes.vector_codes(df).columns and empty.count() == 0


def test_bounds_and_arguments(spark, monkeypatch):
    df = spark.createDataFrame([(1, [0.5] * 16, 1)], DDL)
    with pytest.raises(ValueError):
        codes.vector_codes(df, entries=257)
    monkeypatch.setattr(codes, "CODEBOOK_BYTES", 100)
    with pytest.raises(ValueError):
        codes.vector_codes(df)


def test_only_moving_parts_are_shuffled(spark):
    """Parts that keep their entry stay in the files of their owners."""
    from caseloom.llm.common import shared_dir

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)], 1) for i in range(400)]
    import glob

    had = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/**/codes-*", recursive=True))
    assert codes.vector_codes(spark.createDataFrame(rows, DDL)).count() == 400
    (home,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/**/codes-*", recursive=True)) - had
    split = spark.read.parquet(f"{home}/1")
    moved = spark.read.parquet(f"{home}/1-move").count()
    assert split.count() == 400 * 16 and 0 < moved == split.filter("moved = 'true'").count() < 400 * 16 // 2
    assert spark.read.parquet(f"{home}/0-stay").count() == 400 * 16


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    for scale in (10, 2**20, 2**28):
        x, book = (rng.integers(-scale, scale, (n, 4)) for n in (300, 64))
        book[10] = book[3]
        gap = ((x[:, None] - book[None]) ** 2).sum(2)
        entry, error = codes.nearest(x, book)
        assert (entry == gap.argmin(1)).all() and (error == gap.min(1)).all()
