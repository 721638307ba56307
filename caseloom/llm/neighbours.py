"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= ``COSINE`` have a squared distance of at most
2 - 2 COSINE.  Vectors are rotated (principal axes of a bounded sample, dealt to
blocks so that each block has large and small ones) and split into ``BLOCKS``
blocks in a ring; each block gets a share of the squared distance in proportion
to its variance.  Going round the ring from some block, two similar vectors keep
to the sum of the shares at each step: so there is a block whose own share they
keep to, and with the next block the sum of both.  Each block is range-joined
under these two budgets, and candidates are verified by the exact cosine in
double precision.

Range join: a k-d tree over the block (cuts from the same sample, at most
``MOST_LEAVES`` leaves) gives each vector its home leaf; it also visits every
later leaf whose box is within the block's budget, so two leaves meet once.
Homes and visitors of a leaf are dealt into tiles, so a dense leaf is many
bounded tasks.  What travels is a key and the coordinates of two blocks in half
precision (with a proven slack); a tile answers which of its keys have a
candidate, and full vectors are fetched for those alone and compared tile by
tile.  A pair counts in the first block that it keeps to; tasks return link
counts and forests, never pairs.

Equal vectors are one node with a count from the start, and a node has a key of
its own, whatever ids its vectors have.

Rows: null vectors, empty or zero ones, and those with null or non-finite
components link with nothing; only vectors of one length are compared; rows
with one vec_id count as several vectors under one id; a null id is never the
smallest one, and a vector whose component has none keeps null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import run_dir
from caseloom.llm.graph import connected_components, forest

COSINE = 0.95
BLOCKS = 8
LEAF = 1024
#: Homes and visitors of a tile; a leaf's visitors outnumber its homes. Fewer where vectors are long.
TILE = (8192, 16384)
TILE_BYTES = 64 << 20
MOST_LEAVES = 4096
#: Vectors, and their bytes, that the rotation and the trees are taken from.
SAMPLE = 20_000
SAMPLE_BYTES = 16 << 20


class Blocks:
    """Rotation, blocks, budgets and trees for vectors of one length."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float, leaf: int = LEAF):
        dim = sample.shape[1]
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        value, axes = np.linalg.eigh(np.cov(unit.T, bias=True).reshape(dim, dim) if len(unit) > 1 else np.eye(dim))
        order = np.argsort(-value, kind="stable")
        m = min(BLOCKS, dim)
        snake = [(i % m) if (i // m) % 2 == 0 else m - 1 - i % m for i in range(dim)]
        self.rotation = axes[:, order]
        self.cols = [np.array([i for i in range(dim) if snake[i] == b]) for b in range(m)]
        var = np.array([max(value[order][c].sum(), 1e-12) for c in self.cols])
        limit = 2 - 2 * cosine
        self.budget = limit * var / var.sum() + 1e-9
        self.trees = []
        turned = unit @ self.rotation
        depth = max(0, math.ceil(math.log2(max(1, min(n / leaf, MOST_LEAVES, len(sample) / 8)))))
        for c in self.cols:
            self.trees.append(self._tree(turned[:, c], depth))

    @staticmethod
    def _tree(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cut dimension and place of each inner node in heap order; boxes of the leaves."""
        dims, cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        lo, hi = np.full((1 << depth, x.shape[1]), -np.inf), np.full((1 << depth, x.shape[1]), np.inf)
        todo = [(0, np.arange(len(x)), lo[0].copy(), hi[0].copy())]
        while todo:
            node, rows, a, b = todo.pop()
            if node >= len(dims):
                lo[node - len(dims)], hi[node - len(dims)] = a, b
                continue
            part = x[rows] if len(rows) else x
            d = int(np.argmax(np.percentile(part, 90, axis=0) - np.percentile(part, 10, axis=0)))
            cut = float(np.median(part[:, d]))
            dims[node], cuts[node] = d, cut
            left = x[rows, d] <= cut
            up, down = b.copy(), a.copy()
            up[d], down[d] = min(b[d], cut), max(a[d], cut)
            todo += [(2 * node + 1, rows[left], a, up), (2 * node + 2, rows[~left], down, b)]
        return dims, cuts, lo, hi

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.rotation

    def pair(self, b: int) -> tuple[np.ndarray, float]:
        """Columns of a block and the next one in the ring, and the sum of their budgets."""
        nxt = (b + 1) % len(self.cols)
        if nxt == b:
            return self.cols[b], float(self.budget[b])
        return np.concatenate((self.cols[b], self.cols[nxt])), float(self.budget[b] + self.budget[nxt])

    def keeps(self, gap: np.ndarray) -> np.ndarray:
        """Of each difference of turned vectors, whether it keeps to each block's own budget and to that with the next."""
        own = np.stack([(gap[:, c] ** 2).sum(1) for c in self.cols], 1)
        both = own + np.roll(own, -1, axis=1) if len(self.cols) > 1 else own
        limit = self.budget + np.roll(self.budget, -1) if len(self.cols) > 1 else self.budget
        return (own <= self.budget) & (both <= limit)

    def homes(self, y: np.ndarray, b: int) -> np.ndarray:
        dims, cuts, _, _ = self.trees[b]
        node = np.zeros(len(y), np.int64)
        x = y[:, self.cols[b]]
        while len(dims) and node[0] < len(dims):
            node = 2 * node + 1 + (x[np.arange(len(y)), dims[node]] > cuts[node])
        return node - len(dims)

    def visits(self, y: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each leaf whose box is within the block's budget, the home leaf too."""
        dims, cuts, lo, hi = self.trees[b]
        x = y[:, self.cols[b]]
        r = math.sqrt(self.budget[b]) + 1e-9
        row, node = np.arange(len(y)), np.zeros(len(y), np.int64)
        while len(dims) and node[0] < len(dims):
            gap = x[row, dims[node]] - cuts[node]
            left, right = gap <= r, gap >= -r
            row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
        leaf = node - len(dims)
        off = np.maximum(np.maximum(lo[leaf] - x[row], x[row] - hi[leaf]), 0)
        ok = (off * off).sum(1) <= r * r
        return row[ok], leaf[ok]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors in double precision, scaled by powers of two, which changes no cosine, so that no norm overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0.0))[1]) if len(x) else x


def _hash(keys: np.ndarray) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))).astype(np.int64) & 0x7FFFFFFFFFFF


def _later(blocks: Blocks, y: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home leaf of each row, and (row, leaf) of its visits to its home and later leaves."""
    home = blocks.homes(y, b)
    row, leaf = blocks.visits(y, b)
    ok = leaf >= home[row]
    return home, row[ok], leaf[ok]


def _count(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: Blocks = shared.value[dim]
        home = [np.zeros(len(t[2]), np.int64) for t in blocks.trees]
        seen = [np.zeros(len(t[2]), np.int64) for t in blocks.trees]
        for batch in batches:
            y = blocks.turned(_matrix(batch.column("embedding"), dim))
            for b in range(len(blocks.cols)):
                h, _, leaf = _later(blocks, y, b)
                home[b] += np.bincount(h, minlength=len(home[b]))
                seen[b] += np.bincount(leaf, minlength=len(seen[b]))
        for b in range(len(blocks.cols)):
            k = np.flatnonzero(seen[b])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), b, np.int32)), pa.array(k.astype(np.int32)), pa.array(home[b][k]), pa.array(seen[b][k])], ["block", "leaf", "homes", "visitors"])

    return run


_TILE = "block int, leaf int, h int, v int, blob binary"


def _deal(shared, dim: int, tiles: dict[tuple[int, int], tuple[int, int]]):
    """Keys and coordinates to the tiles: homes (H), visitors from the same leaf (S) and from earlier ones (V)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: Blocks = shared.value[dim]
        for batch in batches:
            y = blocks.turned(_matrix(batch.column("embedding"), dim))
            node = batch.column("node").to_numpy()
            h = _hash(node)
            out: list[tuple[int, int, int, int, bytes]] = []

            def add(b: int, leaf: int, rows: np.ndarray, role: bytes, part: np.ndarray, node=node, h=h, out=out) -> None:
                nh, nv = tiles[b, leaf]
                n, other = (nh, nv) if role == b"H" else (nv, nh)
                for t in np.unique(h[rows] % n).tolist():
                    p = rows[h[rows] % n == t]
                    blob = role + node[p].astype("<i8").tobytes() + part[p].tobytes()
                    for o in range(other):
                        out.append((b, leaf, *((t, o) if role == b"H" else (o, t)), blob))

            for b in range(len(blocks.cols)):
                part = y[:, blocks.pair(b)[0]].astype("<f2")
                home, row, leaf_of = _later(blocks, y, b)
                for leaf in np.unique(leaf_of).tolist():
                    here = row[leaf_of == leaf]
                    own = np.flatnonzero(home == leaf)
                    if len(own):
                        add(b, leaf, own, b"H", part)
                        add(b, leaf, own, b"S", part)
                    here = here[home[here] != leaf]
                    if len(here):
                        add(b, leaf, here, b"V", part)
                while out:
                    some, out[:] = out[:64], out[64:]
                    cols = list(zip(*some, strict=True))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in cols[:4]], pa.array(cols[4], pa.binary())], ["block", "leaf", "h", "v", "blob"])

    return run


_MEMBER = "block int, leaf int, h int, v int, role int, node long"
HOME, SAME, VISITOR = 0, 1, 2


def _sides(table: pa.Table, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and coordinates of homes, of visitors of the same leaf, and of others."""
    blobs, out = table["blob"].to_pylist(), []
    for role in (b"H", b"S", b"V"):
        parts = [x for x in blobs if x[:1] == role]
        n = [(len(x) - 1) // (8 + 2 * width) for x in parts]
        node = [np.frombuffer(x, "<i8", k, 1) for x, k in zip(parts, n, strict=True)]
        part = [np.frombuffer(x, "<f2", k * width, 1 + 8 * k).reshape(k, width) for x, k in zip(parts, n, strict=True)]
        out.append((np.concatenate(node), np.concatenate(part).astype(np.float32)) if parts else (np.zeros(0, np.int64), np.zeros((0, width), np.float32)))
    return out


#: Half precision moves a part of a unit vector by at most this.
_HALF = 2.0**-11 + 1e-6


def slack(budget: float) -> float:
    """A squared distance under ``budget`` stays under this when both ends are rounded to half precision."""
    move = 2 * _HALF
    return budget + (2 * math.sqrt(budget) + move) * move + 1e-5


def _meet(shared, dim: int):
    """In one tile: the keys that have a candidate."""

    def run(table: pa.Table) -> pa.Table:
        blocks: Blocks = shared.value[dim]
        b = table["block"][0].as_py()
        width, (cols, both) = len(blocks.cols[b]), blocks.pair(b)
        (hn, hx), *rest = _sides(table, len(cols))
        own, limit = np.float32(slack(float(blocks.budget[b]))), np.float32(slack(both))
        has_home = np.zeros(len(hn), bool)
        role, node = [], []
        first = hx[:, :width]
        # 2 h.v - |h|^2 - |v|^2 + budget as one product, so that a block of the matrix is only written and compared
        left = np.concatenate((2 * first, np.ones((len(hn), 1), np.float32), -(first * first).sum(1, keepdims=True)), 1)
        for k, (vn, vx) in zip((SAME, VISITOR), rest, strict=True):
            has = np.zeros(len(vn), bool)
            if len(hn) and len(vn):
                v = vx[:, :width]
                right = np.ascontiguousarray(np.concatenate((v, own - (v * v).sum(1, keepdims=True), np.ones((len(vn), 1), np.float32)), 1).T)
                for a in range(0, len(hn), 64):
                    near = np.flatnonzero((left[a : a + 64] @ right).ravel() >= 0)
                    i, j = near // len(vn) + a, near % len(vn)
                    if k == SAME:
                        i, j = i[hn[i] > vn[j]], j[hn[i] > vn[j]]
                    for s in range(0, len(i), 1 << 16):
                        p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                        gap = hx[p] - vx[q]
                        ok = np.einsum("ij,ij->i", gap, gap) <= limit
                        has_home[p[ok]] = True
                        has[q[ok]] = True
            node.append(vn[has])
            role.append(np.full(int(has.sum()), k))
        node.append(hn[has_home])
        role.append(np.full(int(has_home.sum()), HOME))
        node = np.concatenate(node)
        place = [pa.array(np.full(len(node), table[c][0].as_py(), np.int32)) for c in ("block", "leaf", "h", "v")]
        return pa.table([*place, pa.array(np.concatenate(role).astype(np.int32)), pa.array(node)], names=[x.split()[0] for x in _MEMBER.split(", ")])

    return run


_FOUND = "kind int, u long, v long"


def _verify(shared, dim: int, cosine: float):
    """Full vectors of one tile's candidates: link counts (kind 0) and a forest of the links (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        blocks: Blocks = shared.value[dim]
        b = table["block"][0].as_py()
        role, node, weight = (table[c].to_numpy() for c in ("role", "node", "weight"))
        x = _matrix(table["embedding"].combine_chunks(), dim)
        norm, y = np.linalg.norm(x, axis=1), blocks.turned(x)
        home, links = np.flatnonzero(role == HOME), np.zeros(len(node), np.int64)
        cols, most = blocks.cols[b], np.float32(blocks.budget[b] + 1e-5)
        part = y[:, cols].astype(np.float32)
        us, vs = [], []
        for k in (SAME, VISITOR):
            other = np.flatnonzero(role == k)
            for a in range(0, len(home), 256):
                h = home[a : a + 256]
                gap = (part[h] ** 2).sum(1)[:, None] + (part[other] ** 2).sum(1)[None, :] - 2 * part[h] @ part[other].T
                i, j = np.nonzero(gap <= most)
                p, q = h[i], other[j]
                if k == SAME:
                    p, q = p[node[p] > node[q]], q[node[p] > node[q]]
                for s in range(0, len(p), 1 << 15):
                    m, n = p[s : s + (1 << 15)], q[s : s + (1 << 15)]
                    ok = np.einsum("ij,ij->i", x[m], x[n]) / (norm[m] * norm[n]) >= cosine
                    m, n = m[ok], n[ok]
                    keeps = blocks.keeps(y[m] - y[n])
                    first = keeps[:, b] & (keeps.argmax(1) == b)  # the first block that a pair keeps to
                    m, n = m[first], n[first]
                    links += np.bincount(m, weight[n], len(node)).astype(np.int64) + np.bincount(n, weight[m], len(node)).astype(np.int64)
                    fu, fv = forest(node[m], node[n])
                    us.append(fu)
                    vs.append(fv)
        u, v = forest(np.concatenate(us), np.concatenate(vs)) if us else (node[:0], node[:0])
        k = np.flatnonzero(links)
        kind = np.concatenate((np.zeros(len(k), np.int32), np.ones(len(u), np.int32)))
        return pa.table([pa.array(kind), pa.array(np.concatenate((node[k], u))), pa.array(np.concatenate((links[k], v)))], names=["kind", "u", "v"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, leaf: int = LEAF, tile: tuple[int, int] = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    spark = vectors.sparkSession
    home = run_dir(spark, "neighbours")
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    # two hashes name a vector; equal vectors are one node
    name = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"), F.size("embedding").alias("dim")]
    good = rows.filter("ok").select("id", "embedding", *name)
    classes = good.groupBy("k1", "k2", "dim").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    classes.withColumn("node", F.monotonically_increasing_id()).write.partitionBy("dim").parquet(f"{home}/classes")
    kept = spark.read.schema(f"k1 long, k2 long, rep long, weight long, embedding array<{kind}>, node long, dim int").parquet(f"{home}/classes")
    found = None
    for dim, n in sorted((r[0], r[1]) for r in kept.groupBy("dim").count().collect()):
        mine = kept.filter(F.col("dim") == dim).select("node", "weight", "embedding")
        most = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        sample = np.array([r[0] for r in mine.orderBy(F.xxhash64("embedding"), "node").limit(most).select("embedding").collect()], np.float64)
        sample = np.ldexp(sample, -np.frexp(np.abs(sample).max(1, keepdims=True))[1])
        shared = spark.sparkContext.broadcast({dim: Blocks(sample, n, cosine, leaf)})
        count = mine.select("embedding").mapInArrow(_count(shared, dim), "block int, leaf int, homes long, visitors long").groupBy("block", "leaf").agg(F.sum("homes").alias("h"), F.sum("visitors").alias("v"))
        size = [max(1, min(t, TILE_BYTES // (24 * dim))) for t in tile]
        tiles = {(r.block, r.leaf): (max(1, -(-r.h // size[0])), max(1, -(-r.v // size[1]))) for r in count.collect()}
        member = mine.select("node", "embedding").mapInArrow(_deal(shared, dim, tiles), _TILE).groupBy("block", "leaf", "h", "v").applyInArrow(_meet(shared, dim), _MEMBER)
        part = member.join(mine, "node").groupBy("block", "leaf", "h", "v").applyInArrow(_verify(shared, dim, cosine), _FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    found.write.parquet(f"{home}/found")
    found = spark.read.schema(_FOUND).parquet(f"{home}/found")
    links = found.filter("kind = 0").groupBy("u").agg(F.sum("v").alias("n")).withColumnRenamed("u", "node")
    comp = connected_components(found.filter("kind = 1"), "u", "v").withColumnRenamed("id", "node")
    nodes = kept.select("k1", "k2", "dim", "node", "rep", "weight").join(links, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = nodes.groupBy("component").agg(F.min("rep").alias("c"))
    classes = nodes.join(lowest, "component").select("k1", "k2", "dim", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), "c")
    hashed = [F.when(F.col("ok"), c).alias(n) for c, n in ((F.xxhash64("embedding"), "k1"), (F.xxhash64(F.lit(1), "embedding"), "k2"), (F.size("embedding"), "dim"))]
    got = rows.select("id", "ok", *hashed).join(classes, ["k1", "k2", "dim"], "left").withColumn("c", F.coalesce("c", "id"))
    return got.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.col("c").alias("component_id"), F.col("id").eqNullSafe(F.col("c")).alias("kept"))
