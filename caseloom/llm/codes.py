"""Vector code compression by member-resident Lloyd rounds.

Vectors become integers (floor of 256 times each component) and are cut into
``PARTS`` consecutive parts, each with its own codebook.  A part row lives with
the owner of (length, position, entry, salt); the salt spreads an entry that many
rows share over as many owners as it needs.  A round:

* owners sum their resident members; only sums and counts leave, one row for
  each entry, component and task, and make the next codebooks;
* owners hold the new codebooks against their residents: those that stay are
  written where they are, those whose nearest entry changed go to another table,
  and only these cross the next shuffle.

A round is two written tables, so a lost executor costs tasks of one round.
What tasks are sent is the codebooks: entries x length integers for each vector
length, checked against ``CODEBOOK_BYTES``.

Rows: a null vector, or one with a null or non-finite component, is dropped;
vectors of another length have codebooks of their own; a length that ``PARTS``
doesn't divide has parts of lengths that differ by one (a short vector has empty
ones: entry 0, error 0).  With fewer vectors than entries there are so many
entries.  Rows with one vec_id count each, ordered by their components among the
first ones; null ids come last there.  An integer so large that squared distances
could pass 2**62 is held at that bound (for 64 components, beyond 500,000 times
256).  Null labels are equal.  An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import lean, run_dir, small_batches

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Rows of one entry and position that share a salt, about.
OWNER = 1024
CODEBOOK_BYTES = 256 << 20
#: Labels with more than this share of all rows are told to all tasks; there are fewer than its inverse.
HOT_LABEL = 1 / 1024
#: Products of parts and entries at once.
TILE = 1 << 22

Codebooks = dict[int, list[np.ndarray]]


def cuts(dim: int, parts: int) -> list[int]:
    """Where parts of a vector begin and end."""
    return [i * dim // parts for i in range(parts + 1)]


def _lists(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat components (null: nan), lengths and row nulls of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    null = column.is_null().to_numpy(zero_copy_only=False)
    size = np.where(null, 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat, size, null


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) to (vec_id, label, dim, ints)."""
    for batch in batches:
        flat, size, null = _lists(batch["embedding"])
        begin = np.concatenate(([0], np.cumsum(size)))
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
        keep = np.flatnonzero(~null & (bad[begin[1:]] == bad[begin[:-1]]))
        bound = np.array([math.isqrt((1 << 62) // max(int(d), 1)) // 2 for d in size[keep]], np.float64) if len(keep) else np.zeros(0)
        ints = []
        for i, b in zip(keep.tolist(), bound.tolist(), strict=True):
            ints.append(np.clip(np.floor(flat[begin[i] : begin[i + 1]] * 256.0), -b, b).astype("<i4").tobytes())
        rows = batch.take(pa.array(keep))
        yield pa.RecordBatch.from_arrays([rows["vec_id"], rows["label"], pa.array(size[keep], pa.int32()), pa.array(ints, pa.binary())], ["vec_id", "label", "dim", "ints"])


def _order(row: tuple) -> tuple:
    """Sort key of (vec_id, ints)."""
    return (row[0] is None, row[0] or 0, np.frombuffer(row[1], "<i4").tolist())


def _lowest(n: int):
    """The first n rows of each length."""

    def work(batches):
        best: dict[int, list] = {}
        for batch in batches:
            for v, d, x in zip(batch["vec_id"].to_pylist(), batch["dim"].to_pylist(), batch["ints"].to_pylist(), strict=True):
                mine = best.setdefault(d, [])
                mine.append((v, x))
                if len(mine) > 8 * n:
                    best[d] = heapq.nsmallest(n, mine, key=_order)
        rows = [(v, d, x) for d, mine in best.items() for v, x in heapq.nsmallest(n, mine, key=_order)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["vec_id", "dim", "ints"])

    return work


def first_codebooks(kept: DataFrame, entries: int, parts: int) -> Codebooks:
    """Codebooks of the first vectors of each length. Tasks bring their lowest rows together twice before any comes to the driver."""
    ddl = "vec_id long, dim int, ints binary"
    some = kept.select("vec_id", "dim", "ints").mapInArrow(lean(_lowest(entries)), ddl)
    some = some.repartition(64, "vec_id").mapInArrow(lean(_lowest(entries)), ddl)
    by: dict[int, list] = {}
    for r in some.collect():
        by.setdefault(r.dim, []).append((r.vec_id, bytes(r.ints)))
    if 8 * entries * sum(by) > CODEBOOK_BYTES:
        raise ValueError(f"codebooks of {len(by)} vector lengths would take over {CODEBOOK_BYTES} bytes")
    books: Codebooks = {}
    for d, rows in by.items():
        whole = np.stack([np.frombuffer(x, "<i4") for _, x in heapq.nsmallest(entries, rows, key=_order)]).astype(np.int64)
        at = cuts(d, parts)
        books[d] = [whole[:, a:b] for a, b in zip(at, at[1:], strict=False)]
    return books


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, ties to the lower one, and the squared distance; exact in integers."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    entry, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact = 4 * most * most * x.shape[1] < 1 << 53  # every term and sum is a whole number that doubles hold
    step = max(1, TILE // (len(book) * (1 if exact else x.shape[1])))
    wide = book.astype(np.float64)
    own = (wide**2).sum(1)
    for i in range(0, len(x), step):
        y = x[i : i + step]
        if exact:
            z = y.astype(np.float64)
            d = own - 2 * (z @ wide.T)
            e = d.argmin(1)
            error[i : i + step] = (d[np.arange(len(y)), e] + (z**2).sum(1)).astype(np.int64)
        else:
            d = ((y[:, None, :] - book[None]) ** 2).sum(2)
            e = d.argmin(1)
            error[i : i + step] = d[np.arange(len(y)), e]
        entry[i : i + step] = e
    return entry, error


_PART = "row long, dim int, position int, entry int, salt int, part binary"
_NAMES = ["row", "dim", "position", "entry", "salt", "part"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    n, width = x.shape[0], x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x, dtype="<i4"))])


def _matrix(column, rows: np.ndarray, width: int) -> np.ndarray:
    """Binary values of one width as a matrix of integers."""
    if not width:
        return np.zeros((len(rows), 0), np.int64)
    picked = column.take(pa.array(rows))
    picked = picked.combine_chunks() if isinstance(picked, pa.ChunkedArray) else picked
    _, offs, data = picked.buffers()
    at = np.frombuffer(offs, np.int32)[picked.offset : picked.offset + len(picked) + 1]
    return np.frombuffer(data, "<i4", count=len(rows) * width, offset=int(at[0])).reshape(len(rows), width).astype(np.int64)


def _dealt(books: Codebooks, parts: int, salts: int):
    """Vectors to part rows under their first entry."""

    def work(batches):
        for batch in batches:
            dims, row = batch["dim"].to_numpy(zero_copy_only=False), batch["row"].to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == d)
                x, at = _matrix(batch["ints"], mine, d), cuts(d, parts)
                salt = (_mixed(row[mine]) % np.uint64(salts)).astype(np.int32)
                for p in range(parts):
                    part = x[:, at[p] : at[p + 1]]
                    entry, _ = nearest(part, books[d][p])
                    same = [pa.array(np.full(len(mine), v, np.int32)) for v in (d, p)]
                    yield pa.RecordBatch.from_arrays([pa.array(row[mine]), *same, pa.array(entry, pa.int32()), pa.array(salt), _binary(part)], _NAMES)

    return work


def _groups(batch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(dim, position, rows) of a batch of parts."""
    dims, pos = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "position"))
    key = dims << 16 | pos
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(key[order])) + 1
    for rows in np.split(order, edges) if len(order) else ():
        yield int(dims[rows[0]]), int(pos[rows[0]]), np.sort(rows)


def _width(dim: int, position: int, parts: int) -> int:
    return (position + 1) * dim // parts - position * dim // parts


def _sums(parts: int, entries: int):
    """Members of each entry, and their sum in each component; component -1 is the count."""

    def work(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            entry = batch["entry"].to_numpy(zero_copy_only=False)
            for d, p, rows in _groups(batch):
                w = _width(d, p, parts)
                x = _matrix(batch["part"], rows, w)
                mine = total.setdefault((d, p), np.zeros((entries, w + 1), np.int64))
                np.add.at(mine, entry[rows], np.concatenate((np.ones((len(rows), 1), np.int64), x), 1))
        out = []
        for (d, p), m in total.items():
            e, j = np.nonzero((m[:, :1] > 0) & np.ones(m.shape, bool))
            out.append((np.full(len(e), d), np.full(len(e), p), e, j - 1, m[e, j]))
        if out:
            d, p, e, j, s = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(j, pa.int32()), pa.array(s, pa.int64())], ["dim", "position", "entry", "component", "total"])

    return work


def updated(members: DataFrame, books: Codebooks, parts: int, entries: int) -> Codebooks:
    """Each entry replaced by the floor of its members' mean; one without members stays."""
    sums = members.select("dim", "position", "entry", "part").mapInArrow(lean(_sums(parts, entries)), "dim int, position int, entry int, component int, total long")
    got = sums.groupBy("dim", "position", "entry", "component").agg(F.sum("total").alias("total")).toPandas()
    new = {d: [b.copy() for b in book] for d, book in books.items()}
    count = {(r.dim, r.position, r.entry): r.total for r in got[got.component < 0].itertuples()}
    for r in got[got.component >= 0].itertuples():
        new[r.dim][r.position][r.entry, r.component] = r.total // count[r.dim, r.position, r.entry]
    return new


def _moved(books: Codebooks, parts: int):
    """Residents under new codebooks; moved: their nearest entry is another."""

    def work(batches):
        for batch in batches:
            old = batch["entry"].to_numpy(zero_copy_only=False)
            new = np.empty(len(old), np.int32)
            for d, p, rows in _groups(batch):
                new[rows], _ = nearest(_matrix(batch["part"], rows, _width(d, p, parts)), books[d][p])
            columns = [pa.array(new) if c == "entry" else batch[c] for c in _NAMES]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(new != old)], [*_NAMES, "moved"])

    return work


def _coded(books: Codebooks, parts: int):
    """Each part's entry in its place of two longs, and its squared distance."""

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            high, low, error = (np.zeros(n, np.int64) for _ in range(3))
            for d, p, rows in _groups(batch):
                e, error[rows] = nearest(_matrix(batch["part"], rows, _width(d, p, parts)), books[d][p])
                (high if p < 8 else low)[rows] = e << (8 * (7 - p % 8))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(high), pa.array(low), pa.array(error)], ["row", "high", "low", "error"])

    return work


def codebooks_text(book: list[np.ndarray]) -> str:
    """All components by part, entry and place."""
    return ",".join(str(v) for b in book for v in b.ravel().tolist())


def _with_label_error(rows: DataFrame, n: int) -> DataFrame:
    """Adds the errors of all rows of a label. Frequent labels, fewer than 1 / HOT_LABEL of them, are broadcast; the others meet by a shuffle."""
    by = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")).withColumn("_none", F.col("label").isNull())
    hot = by.filter(F.col("_n") > n * HOT_LABEL).select(F.col("label").alias("_label"), F.col("label_error").alias("_hot"))
    known = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    cold = by.filter(F.col("_n") <= n * HOT_LABEL).select(F.col("label").alias("_label"), "label_error")
    # rows that know already carry no key into the shuffle: they are a side of their own
    rest = known.filter("_hot is null").drop("_hot").join(cold, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return known.filter("_hot is not null").withColumnRenamed("_hot", "label_error").unionByName(rest)


def vector_codes(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256): one row for each vector without null or non-finite components.

    code: the entry of each part, two hex digits each (so at most 256 entries);
    error: squared distances to them; label_error: summed over rows of the same
    label; codebooks_sha256: of the final codebooks' components.
    """
    if not 0 < entries <= 256 or rounds < 0:
        raise ValueError("entries must be 1 to 256, rounds not negative")
    spark = embeddings.sparkSession
    small_batches(spark)
    home = run_dir(spark, "codes")
    label = embeddings.schema["label"].dataType.simpleString()
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    ints = base.mapInArrow(lean(_quantised), f"vec_id long, label {label}, dim int, ints binary")
    # a row's number is fixed by being written
    ints.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{home}/vectors")
    kept = spark.read.parquet(f"{home}/vectors")
    n = kept.count()
    if not n:
        return spark.createDataFrame([], f"vec_id long, label {label}, code string, error long, label_error long, codebooks_sha256 string")
    books = first_codebooks(kept, entries, PARTS)
    owner = ["dim", "position", "entry", "salt"]
    read = spark.read.schema(_PART).parquet
    dealt = kept.select("row", "dim", "ints").mapInArrow(lean(_dealt(books, PARTS, -(-n // OWNER))), _PART)
    dealt.repartition(*owner).write.parquet(f"{home}/0-stay")
    members = read(f"{home}/0-stay")
    for k in range(rounds):
        books = updated(members, books, PARTS, entries)
        if k + 1 == rounds:
            break
        split = members.mapInArrow(lean(_moved(books, PARTS)), f"{_PART}, moved boolean")
        split.write.partitionBy("moved").parquet(f"{home}/{k + 1}")
        now = spark.read.schema(f"{_PART}, moved boolean").parquet(f"{home}/{k + 1}")
        now.filter("moved").drop("moved").repartition(*owner).write.parquet(f"{home}/{k + 1}-move")
        members = now.filter("not moved").drop("moved").unionByName(read(f"{home}/{k + 1}-move"))
    coded = members.select("row", "dim", "position", "part").mapInArrow(lean(_coded(books, PARTS)), "row long, high long, low long, error long")
    whole = coded.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("high", "low", "error")))
    code = F.concat(*(F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("high", "low")))
    sha = spark.createDataFrame([(d, hashlib.sha256(codebooks_text(b).encode()).hexdigest()) for d, b in books.items()], "dim int, codebooks_sha256 string")
    rows = kept.select("row", "vec_id", "label", "dim").join(whole, "row").join(F.broadcast(sha), "dim").select("vec_id", "label", code.alias("code"), "error", "codebooks_sha256")
    rows.write.parquet(f"{home}/coded")
    return _with_label_error(spark.read.schema(rows.schema).parquet(f"{home}/coded"), n).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
