"""State machines over one key's events in order, split over tasks.

A key may hold a third of all events, so events are dealt by ranges of (key,
time): a hot key fills many partitions, each a sorted stream.  A partition turns
its piece of a key into a summary that says what comes out for whatever goes in;
summaries compose, so a key's answer is a fold over as many summaries as it has
partitions.

* attempts: entry counter -> exit counter and time of the block.  The map is told
  by the failures before the first success, whether there is one, the first block
  after it, and the failures at the end.
* windows from the first request: end of the open window at entry -> end at exit.
  Starts jump to the first request after their window; pointer jumping gives each
  possible entry its exit.  The map rises with the entry, so equal exits are one
  step, and chains that have met stay together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranges(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows in sorted partitions by ``order``; rows that are equal in it are split too, as any order of them does."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    any_ = F.monotonically_increasing_id()
    return rows.withColumn("_any", any_).repartitionByRange(n, *order, F.col("_any")).sortWithinPartitions(*order).drop("_any")


def ticks(column: pa.Array) -> np.ndarray:
    """Times as whole numbers."""
    if pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def times(values: list[int | None], kind: pa.DataType) -> pa.Array:
    out = pa.array(values, pa.int64())
    return (out.cast(pa.int32()) if pa.types.is_date32(kind) else out).cast(kind)


def _segments(keys: pa.Array) -> np.ndarray:
    """Where runs of equal keys begin, with the end."""
    codes = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy()
    return np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes)) if len(codes) else np.zeros(1, np.int64)


# --- attempts ----------------------------------------------------------------

#: failures before the first success (as far as they matter), their times, whether there is a success, time of the first block after it, failures at the end
Piece = tuple[int, tuple[int, ...], bool, int | None, int]


def joined(a: Piece, b: Piece, limit: int) -> Piece:
    """The map of a, then b."""
    if not a[2]:
        lead = min(limit, a[0] + b[0])
        return lead, (a[1] + b[1])[:limit], b[2], b[3], b[4] if b[2] else lead
    block = a[3]
    if block is None and a[4] + b[0] >= limit:
        block = b[1][limit - a[4] - 1]
    if block is None:
        block = b[3]
    return a[0], a[1], True, block, b[4] if b[2] else min(limit, a[4] + b[0])


def pieces(at: np.ndarray, bad: np.ndarray, edge: np.ndarray, limit: int) -> list[Piece]:
    """The map of each run of rows edge[i]:edge[i + 1]."""
    n, first = len(at), edge[:-1]
    seg = np.repeat(np.arange(len(first)), np.diff(edge))
    good, place = ~bad, np.arange(n)
    wins = np.cumsum(good)
    inside = wins - (wins[first] - good[first])[seg] > 0  # after a success of its own run
    lead = np.bincount(seg[~inside], minlength=len(first))
    streak = place - np.maximum.accumulate(np.where(good, place, -1))
    hit = np.flatnonzero(inside & bad & (streak >= limit))
    where, which = np.unique(seg[hit], return_index=True)
    block = dict(zip(where.tolist(), at[hit[which]].tolist(), strict=True))
    last = edge[1:] - 1
    tail = np.where(inside[last], np.where(bad[last], streak[last], 0), lead)
    return [
        (min(k, limit), tuple(at[s : s + min(k, limit)].tolist()), k < z - s, block.get(i), min(t, limit))
        for i, (s, z, k, t) in enumerate(zip(first.tolist(), edge[1:].tolist(), lead.tolist(), tail.tolist(), strict=True))
    ]


def attempt_pieces(ordered: DataFrame, limit: int, key_type: str, at_type: str) -> DataFrame:
    """(key, part, lead, lead_at, success, block, tail) of (key, at, bad) in sorted partitions: one row for each key of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_: tuple | None = None  # a key and its piece so far

        def rows(told: list[tuple]) -> pa.RecordBatch:
            flat = [x for _, p in told for x in p[1]]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p[1]) for _, p in told)]), pa.int32()), times(flat, kind))
            columns = [pa.concat_arrays([k for k, _ in told]), pa.array([part] * len(told), pa.int32()), pa.array([p[0] for _, p in told], pa.int32()), lists]
            columns += [pa.array([p[2] for _, p in told]), times([p[3] for _, p in told], kind), pa.array([p[4] for _, p in told], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["key", "part", "lead", "lead_at", "success", "block", "tail"])

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, kind = batch.column(0), batch.column(1).type
            edge = _segments(keys)
            told = list(zip((keys.slice(int(i), 1) for i in edge[:-1]), pieces(ticks(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(bool), edge, limit), strict=True))
            if open_ is not None:
                if open_[0].equals(told[0][0]):
                    told[0] = (told[0][0], joined(open_[1], told[0][1], limit))
                else:
                    told.insert(0, open_)
            open_ = told.pop()
            if told:
                yield rows(told)
        if open_ is not None:
            yield rows([open_])

    return ordered.mapInArrow(run, f"key {key_type}, part int, lead int, lead_at array<{at_type}>, success boolean, block {at_type}, tail int")


def folded(told: DataFrame, limit: int) -> DataFrame:
    """(key, n, blocked_at) of the pieces, each key's in the order of its partitions."""
    kind = told.schema["block"].dataType
    one = told.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "lead", "lead_at", "success", "block", "tail"))).alias("p"))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast(kind).alias("at"))

    def step(s: Column, x: Column) -> Column:
        at = F.when(s["n"] + x["lead"] >= limit, F.get(x["lead_at"], limit - s["n"] - 1)).otherwise(x["block"])
        n = F.when(x["success"], x["tail"]).otherwise(F.least(s["n"] + x["lead"], F.lit(limit)))
        return F.when(s["at"].isNotNull(), s).otherwise(F.struct(n.cast("int").alias("n"), at.alias("at")))

    return one.select("key", F.aggregate("p", start, step).alias("s")).select("key", F.col("s.n").alias("n"), F.col("s.at").alias("blocked_at"))


# --- windows from the first request ------------------------------------------


def steps(t: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(latest entries, exits) of a piece's map: an entry up to the first of these leaves with its exit, one up to the next with the next; a later one passes by.

    t rises; an entry is the end of the window open before, so at most t[0] + width.
    """
    n = len(t)
    nxt = np.searchsorted(t, t + width)
    jump = np.where(nxt < n, nxt, np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    m = min(n, int(np.searchsorted(t, t[0] + width)) + 1)
    out = t[jump[:m]] + width
    keep = np.append(out[1:] != out[:-1], True)
    return t[:m][keep], out[keep]


def through(entry: int | None, latest: np.ndarray, exits: np.ndarray) -> int:
    """The exit of an entry (None: no window is open)."""
    i = 0 if entry is None else int(np.searchsorted(latest, entry))
    return int(exits[i]) if i < len(exits) else int(entry)


def _partition(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
    """Keys, times and counts of a whole sorted partition: 16 bytes a row, and the keys in runs."""
    keys, at, n = [], [], []
    for b in batches:
        keys.append(b.column(0))
        at.append(b.column(1).to_numpy())
        n.append(b.column(2).to_numpy())
    if not keys or not sum(len(k) for k in keys):
        return None
    return pa.concat_arrays(keys), np.concatenate(at), np.concatenate(n)


_STEPS = "part int, latest binary, exits binary"


def edge_steps(ordered: DataFrame, width: int, key_type: str) -> DataFrame:
    """(key, part, latest, exits) of the first and the last key of each partition of (key, at, n): no other key can stand in two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (got := _partition(batches)) is None:
            return
        keys, at, _ = got
        edge = _segments(keys)
        out = [(i, *steps(at[edge[i] : edge[i + 1]], width)) for i in sorted({0, len(edge) - 2})]
        part = [TaskContext.get().partitionId()] * len(out)
        columns = [pa.concat_arrays([keys.slice(int(edge[i]), 1) for i, _, _ in out]), pa.array(part, pa.int32())]
        columns += [pa.array([x[k].astype("<i8").tobytes() for x in out], pa.binary()) for k in (1, 2)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "part", "latest", "exits"])

    return ordered.mapInArrow(run, f"key {key_type}, {_STEPS}")


def entries(edges: DataFrame) -> dict[int, int]:
    """Of each partition whose first key stands in the one before too: the end of the window that is open there. At most one a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, end = None, None
        for b in batches:
            parts, ends = [], []
            for i in range(b.num_rows):
                own = b.column(0).slice(i, 1)
                if key is None or not own.equals(key):
                    key, end = own, None
                if end is not None:
                    parts.append(b.column(1)[i].as_py())
                    ends.append(end)
                end = through(end, *(np.frombuffer(b.column(k)[i].as_py(), "<i8") for k in (2, 3)))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(ends, pa.int64())], ["part", "entry"])

    got = edges.repartition("key").sortWithinPartitions("key", "part").mapInArrow(run, "part int, entry bigint")
    return {r.part: r.entry for r in got.collect()}


def window_hits(ordered: DataFrame, entry: dict[int, int], width: int, limit: int, key_type: str) -> DataFrame:
    """(key, at, hits) of windows, in pieces where a window reaches over partitions; whole ones only with more than ``limit`` hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (got := _partition(batches)) is None:
            return
        keys, at, n = got
        total, edge = np.append(0, np.cumsum(n)), _segments(keys)
        found: list[tuple[int, int, int]] = []
        for k, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            i, end = a, entry.get(TaskContext.get().partitionId()) if k == 0 else None
            while i < z:
                begin, whole = (int(at[i]), True) if end is None else (end - width, False)
                j = a + int(np.searchsorted(at[a:z], begin + width))
                hits = int(total[j] - total[i])
                open_ = j == z and k == len(edge) - 2
                if hits and (hits > limit or open_ or not whole):
                    found.append((a, begin, hits))
                i, end = j, None
        columns = [keys.take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "at", "hits"])

    return ordered.mapInArrow(run, f"key {key_type}, at bigint, hits bigint")
