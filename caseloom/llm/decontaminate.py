"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is its set of distinct shingles of five words (A-Z lower-cased); an
item of fewer words is its one run of words, looked for among the documents'
runs of that length.  Items are partitioned by set size, in powers of two.  A
partition keeps, for each item, the bottom-k MinHash shingles, with k set by
the partition's largest size so that a document with a share of ``CONTAINED``
of the item's shingles must hold one of them: no such document is missed.
Documents of any length are probed shingle by shingle against these small
tables, and hits are verified by exact shingle containment.

Items come to the driver in chunks of ``ITEMS_A_CHUNK`` items and ``BYTES_A_CHUNK``
bytes at most on average, dealt by id and text (rows equal in both are
one), and each chunk is one pass over the documents, so what is
broadcast is bounded.

Rows: null or empty documents hold nothing; items without words match nothing;
an item that stands twice is reported under each item_id; equal documents get
equal answers; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import bytes_of, lean, small_batches, spans_of
from caseloom.llm.hashing import U, shingles, words

WORDS = 5
CONTAINED = 75  # percent
ITEMS_A_CHUNK = 100_000
BYTES_A_CHUNK = 32 << 20
_SIEVE = 20


def needed(size):
    """The least count that is CONTAINED percent of size."""
    return -(-CONTAINED * np.asarray(size) // 100)


class Items:
    """Test items as shingle sets, with bottom-k signatures by size partition."""

    def __init__(self, ids: list, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        off = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        h, _, _, at = words(np.frombuffer(b"".join(raw), np.uint8), off)
        count = np.diff(at)
        self.ids = np.array(ids, object)
        self.sets: list[np.ndarray] = []
        #: by run length: sorted signature hashes, the item of each, and a sieve of their high bits
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sig: dict[int, list[tuple[np.ndarray, int]]] = {}
        full, _, begin = shingles(h, at, WORDS)
        for i in range(len(ids)):
            k = min(WORDS, int(count[i]))
            if k in (0, WORDS):
                own = np.unique(full[begin[i] : begin[i + 1]])
            else:
                own = shingles(h[at[i] : at[i + 1]], np.array([0, k]), k)[0]
            self.sets.append(own)
            if len(own):
                largest = (1 << int(len(own)).bit_length()) - 1  # of the item's size partition
                bottom = min(len(own), int(largest - needed(largest) + 1))
                sig.setdefault(k, []).append((own[:bottom], i))
        for k, some in sig.items():
            v = np.concatenate([x for x, _ in some])
            who = np.repeat([i for _, i in some], [len(x) for x, _ in some])
            order = np.argsort(v, kind="stable")
            sieve = np.zeros(1 << _SIEVE, bool)
            sieve[(v >> U(64 - _SIEVE)).astype(np.int64)] = True
            self.tables[k] = (v[order], who[order], sieve)

    def find(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, shared shingles, item's shingles) of all contained items."""
        h, _, _, at = words(data, off)
        out = []
        for k, (sig, who, sieve) in self.tables.items():
            run, row, begin = shingles(h, at, k)
            if k < WORDS:
                full = np.diff(at) >= k
                keep = full[row]
            else:
                keep = np.ones(len(run), bool)
            maybe = np.flatnonzero(sieve[(run >> U(64 - _SIEVE)).astype(np.int64)] & keep)
            lo = np.searchsorted(sig, run[maybe], "left")
            hi = np.searchsorted(sig, run[maybe], "right")
            hit = hi > lo
            maybe, lo, hi = maybe[hit], lo[hit], hi[hit]
            n = hi - lo
            if not len(n):
                continue
            item = who[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pairs = np.unique(np.stack([np.repeat(row[maybe], n), item], 1), axis=0)
            last, own = -1, None
            for r, i in pairs.tolist():
                if r != last:
                    last, own = r, np.unique(run[begin[r] : begin[r + 1]])
                q = self.sets[i]
                at_q = np.searchsorted(own, q)
                shared = int((own[np.minimum(at_q, len(own) - 1)] == q).sum())
                if shared >= needed(len(q)):
                    out.append((r, i, shared, len(q)))
        return out


def _chunks(benchmark: DataFrame) -> Iterator[Items]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-size["n"] // ITEMS_A_CHUNK), -(-size["bytes"] // BYTES_A_CHUNK))
    for i in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()
        yield Items([r.item_id for r in rows], [r.text for r in rows])


def _on_items(work, shared):
    """``work(items, batches)`` with the items taken from their broadcast on the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(shared.value, batches)

    return lean(run)


def contained_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each item that a document holds."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in _chunks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column("doc_id")
                data, off = bytes_of(b.column("text"))
                for i, j in spans_of(off, 1 << 20):
                    got = items.find(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    if got:
                        r, k, n, q = (np.array(x) for x in zip(*got, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(r + i)), pa.array(items.ids[k], pa.int64()), pa.array(n, pa.int64()), pa.array(q, pa.int64()), pa.array(n / q, pa.float64())],
                            ["doc_id", "item_id", "n_shared", "n_item", "containment"],
                        )

        part = base.mapInArrow(_on_items(run, shared), "doc_id long, item_id long, n_shared long, n_item long, containment double")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with their columns. One pass over the documents for each chunk of items."""
    small_batches(docs.sparkSession)
    for items in _chunks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, off = bytes_of(b.column("text"))
                keep = np.ones(b.num_rows, bool)
                for i, j in spans_of(off, 1 << 20):
                    keep[[i + r for r, *_ in items.find(data[off[i] : off[j]], off[i : j + 1] - off[i])]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(_on_items(run, shared), docs.schema)
    return docs


__all__ = ["Items", "clean", "contained_items"]
