"""Embedding near-duplicates against brute force."""

import math

import numpy as np
import pytest

from caseloom.llm import neighbours
from tests.llm.util import rows_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.95):
    x = []
    for _, e, _ in rows:
        v = None if e is None or any(c is None or not math.isfinite(c) for c in e) else np.array(e, np.float32).astype(float)
        x.append(v if v is not None and len(v) and np.linalg.norm(v) > 0 else None)
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(x):
        for j in range(i):
            b = x[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                if rows[p][0] > rows[q][0]:
                    p, q = q, p
                root[q] = p
    return sorted(((r[0], links[i], rows[find(i)][0], rows[find(i)][0] == r[0]) for i, r in enumerate(rows)), key=str)


def vectors(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(20, dim))
    rows = []
    for i in range(n):
        v = rng.normal(size=dim) if rng.random() < 0.3 else centre[rng.integers(0, 20)] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.25])
        rows.append((i * 3, (v * rng.choice([1, 5])).astype(np.float32).tolist(), 0))
    return rows


@pytest.mark.parametrize(("seed", "leaf", "tile"), [(1, 4096, (2048, 2048)), (2, 20, (7, 9)), (3, 60, (1000, 30))])
def test_matches_brute_force(spark, seed, leaf, tile):
    rows = vectors(seed)
    rows += [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [1.0, None] * 8, 1), (9005, [float("nan")] * 16, 1), (9006, [float("inf")] + [1.0] * 15, None), (9007, [1.0, 2.0, 3.0], 2), (9008, [2.0, 4.0, 6.0], 2), (9009, [0.5], 0)]
    got = rows_of(neighbours.near_duplicates(spark.createDataFrame(rows, SCHEMA), leaf=leaf, tile=tile))
    assert got == brute(rows)


def test_no_vector_at_all(spark):
    assert rows_of(neighbours.near_duplicates(spark.createDataFrame([], SCHEMA))) == []
    got = rows_of(neighbours.near_duplicates(spark.createDataFrame([(4, None, 1), (None, [0.0], 1)], SCHEMA)))
    assert got == [(4, 0, 4, True), (None, 0, None, True)]


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rep", "2 AS dim", "3 AS k1", "4 AS id")
    got = rows_of(neighbours.near_duplicates(df).select("vec_id", "n_links"))
    assert got == [(1, 0), (1, 2), (1, 2), (None, 2)]


def test_double_precision_and_large_components(spark):
    """Vectors that are one in single precision are two in double; components beyond its range are finite."""
    e = 1e-9
    rows = [(5, [1.0, 0.0], 0), (3, [1.0, e], 0), (None, [1e300, 1e200], 0), (None, [0.0, -1e300], 0), (7, [1e-300, 1.1e-300], 0), (8, [2e200, 2.2e200], 0), (9, [0.0, -1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert rows_of(neighbours.near_duplicates(df)) == sorted([(3, 2, 3, True), (5, 2, 3, False), (None, 2, 3, False), (None, 1, 9, False), (9, 1, 9, True), (7, 1, 7, True), (8, 1, 7, False)], key=str)
    # just above and below the cosine, by less than single precision tells
    c = 0.95
    near = [(1, [1.0, 0.0], 0)] + [(i, [c + d, float(np.sqrt(1 - (c + d) ** 2))], 0) for i, d in ((2, 1e-10), (3, -1e-10))]
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(spark.createDataFrame(near, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_ring_of_blocks_keeps_every_close_pair_and_drops_most_others():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 64))
    x[350:] = x[:350] + rng.normal(size=(350, 64)) * 0.2
    b = neighbours.Blocks(x, 700, 0.95, leaf=50)
    y = b.turned(x)
    i, j = np.triu_indices(700, 1)
    near = (y[i] * y[j]).sum(1) >= 0.95
    keeps = b.keeps(y[i] - y[j])
    assert near.sum() > 100 and keeps[near].any(1).all() and keeps[~near].any(1).mean() < 0.01
    half = y.astype(np.float16).astype(np.float32)
    for k in range(len(b.cols)):  # rounding to half precision loses no candidate
        cols, both = b.pair(k)
        gap = half[i] - half[j]
        got = ((gap[:, b.cols[k]] ** 2).sum(1) <= neighbours.slack(b.budget[k])) & ((gap[:, cols] ** 2).sum(1) <= neighbours.slack(both))
        assert got[keeps[:, k]].all()


def test_budgets_cover_every_close_pair():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12))
    b = neighbours.Blocks(x, 400, 0.9, leaf=40)
    y = b.turned(x)
    gap = ((y[:, None, :] - y[None, :, :]) ** 2)
    near = gap.sum(2) <= 2 - 2 * 0.9
    in_block = np.stack([gap[:, :, c].sum(2) <= v for c, v in zip(b.cols, b.budget, strict=True)])
    assert (in_block.any(0) | ~near).all()
    for k in range(len(b.cols)):
        home = b.homes(y, k)
        row, leaf = b.visits(y, k)
        seen = set(zip(row.tolist(), leaf.tolist(), strict=True))
        assert all((int(i), int(home[j])) in seen for i, j in zip(*np.nonzero(in_block[k]), strict=True))
