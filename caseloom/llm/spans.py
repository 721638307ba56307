"""Substring deduplication by sliding sentence spans.

A text is parted into sentences: a sentence ends with ``.``, ``!`` or ``?``
before white space, with a line end, or with the text.  Every run of
``SENTENCES`` or more consecutive sentences of a text with ``LEAST_WORDS`` words
or more is hashed by the words of its sentences (A-Z lower-cased, white space
aside); of the runs that begin at one sentence the shortest stands for all, as a
longer repeated one is covered by shortest ones and what it repeats of them.
Runs meet by 128 bits of hash over all documents; all sentences of a run that
also stands earlier (smaller doc_id, or the same document, earlier) go, with the
white space after them.  The least number of words keeps stock lines of a few
words in documents that repeat nothing else; 1 hashes every run.  The last
sentences of a text that together have fewer words begin no run.

Rows: null text counts as empty and loses nothing; of equal rows with one id
the later of (doc_id, text) order loses its runs; null ids come first; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseloom.llm.common import bucket_count, bytes_of, id_column, in_order, int_column, lean, sharded
from caseloom.llm.hashing import joined, mix, sums, words
from caseloom.llm.suffix import bucket_of

#: Sentences of a run: the fewest that are several; and words.
SENTENCES = 2
LEAST_WORDS = 15
#: Numbers that name a run.
WIDTH = 2


def sentences(data: np.ndarray, off: np.ndarray):
    """Of concatenated rows: where each sentence's words begin (with the end of all), its first byte and row; and the words' hashes."""
    h, s, e, at = words(data, off)
    if not len(s):
        z = np.zeros(0, np.int64)
        return np.zeros(1, np.int64), z, z, h
    line = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 10, out=line[1:])
    tail = data[e - 1]
    stop = (tail == 46) | (tail == 33) | (tail == 63)
    new = np.ones(len(s), bool)
    new[1:] = stop[:-1] | (line[s[1:]] > line[s[:-1]])
    new[at[:-1][at[:-1] < at[1:]]] = True
    first = np.flatnonzero(new)
    return np.append(first, len(s)), s[first], np.searchsorted(off, s[first], "right") - 1, h


def runs(word_at: np.ndarray, row: np.ndarray, length: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first sentence, last + 1) of the shortest run from each sentence that has so many sentences and words, in its row."""
    n = len(row)
    first = np.arange(n)
    last = np.maximum(first + length, np.searchsorted(word_at, word_at[:n] + least)) if n else first
    end = np.searchsorted(row, row, "right")
    ok = last <= end
    return first[ok], last[ok]


class Names:
    """Names of a shard's runs (one or two numbers each, by column), and the distinct ones by bucket."""

    def __init__(self, columns: list[np.ndarray], n_buckets: int):
        n = len(columns[0])
        order = np.lexsort(columns[::-1])
        new = np.zeros(n, bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[order[1:]] != c[order[:-1]]
        first = order[new]
        key = np.empty(n, np.int64)
        key[order] = np.cumsum(new) - 1
        #: all but the first of each name in the shard
        self.later = np.ones(n, bool)
        self.later[first] = False
        bucket = bucket_of(columns[0][first], n_buckets)
        by = np.argsort(bucket, kind="stable")
        self.sent = np.stack([c[first[by]] for c in columns], 1)
        self.bucket = bucket[by]
        place = np.empty(len(first), np.int64)
        place[by] = np.arange(len(first))
        self.place = place[key]  # among the sent, of each run

    def messages(self) -> tuple[np.ndarray, list[bytes]]:
        b, at = np.unique(self.bucket, return_index=True)
        at = np.append(at, len(self.bucket))
        return b, [self.sent[i:j].astype("<u8").tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]

    def repeated(self, said: list[tuple[int, bytes]]) -> np.ndarray:
        """Which runs also stand earlier, in this shard or by what the buckets said."""
        earlier = np.zeros(len(self.sent), bool)
        at = np.searchsorted(self.bucket, np.arange(self.bucket.max(initial=0) + 2))
        for b, blob in said:
            earlier[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8))[: at[b + 1] - at[b]] == 1
        return self.later | earlier[self.place]


class ShardSpans:
    """A shard's rows in (doc_id, text) order, their sentences and runs."""

    def __init__(self, table: pa.Table, n_buckets: int, length: int, least: int):
        data, off = bytes_of(table["text"])
        self.ids, self.data, self.off = in_order(int_column(table, "doc_id"), data, off)
        word_at, self.start, self.row, h = sentences(self.data, self.off)
        self.first, self.last = runs(word_at, self.row, length, least)
        extent = self.last - self.first
        size = np.diff(word_at)
        place = np.arange(len(h)) - np.repeat(word_at[:-1], size)
        columns = []
        for seed in range(WIDTH):
            one = sums(h, place, word_at[:-1], size, seed) if len(h) else h
            x = one[self.first]
            for k in range(1, int(extent.max(initial=1))):
                on = np.flatnonzero(extent > k)
                x[on] = joined(x[on], one[self.first[on] + k])
            columns.append(mix(x))
        self.names = Names(columns, n_buckets)

    def removed(self, said: pa.Table) -> np.ndarray:
        """Which sentences lie in a run that stands earlier."""
        gone = self.names.repeated(list(zip(said["bucket"].to_pylist(), said["blob"].to_pylist(), strict=True)))
        mark = np.zeros(len(self.row) + 1, np.int64)
        np.add.at(mark, self.first[gone], 1)
        np.subtract.at(mark, self.last[gone], 1)
        return np.cumsum(mark[:-1]) > 0


_TOLD = "bucket int, shard int, blob binary"


def _table(bucket, shard, blob) -> pa.Table:
    return pa.table([pa.array(bucket, pa.int32()), pa.array(shard, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "shard", "blob"])


def _tell(n_buckets: int, length: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        buckets, blobs = ShardSpans(table, n_buckets, length, least).names.messages()
        return _table(buckets, [table["shard"][0].as_py()] * len(blobs), blobs)

    return run


def _first_shard(table: pa.Table) -> pa.Table:
    """In one bucket: a bit for each name that an earlier shard sent too."""
    shard, blobs = table["shard"].to_pylist(), table["blob"].to_pylist()
    order = sorted(range(len(shard)), key=lambda i: shard[i])
    h = np.concatenate([np.frombuffer(blobs[i], "<u8") for i in order]).reshape(-1, WIDTH)
    by = np.lexsort([h[:, c] for c in reversed(range(WIDTH))])
    again = np.zeros(len(h), np.uint8)
    again[by[1:]] = (h[by[1:]] == h[by[:-1]]).all(1)
    end = np.cumsum([len(blobs[i]) // (8 * WIDTH) for i in order])
    out = [np.packbits(again[a:b]).tobytes() for a, b in zip(np.concatenate(([0], end[:-1])), end, strict=True)]
    return _table([table["bucket"][0].as_py()] * len(order), [shard[i] for i in order], out)


_RESULT = "doc_id long, n_sentences long, n_removed long, bytes_removed long, text string"


def _cut(n_buckets: int, length: int, least: int):
    def run(key, texts: pa.Table, said: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in _RESULT.split(", ")]
        if texts.num_rows == 0:
            return pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.string())], names=names)
        own = ShardSpans(texts, n_buckets, length, least)
        gone = own.removed(said)
        n = len(own.ids)
        mark = np.zeros(len(own.data) + 1, np.int32)
        g = np.flatnonzero(gone)
        nxt = np.append(own.start[1:], 0)
        last = np.append(own.row[1:] != own.row[:-1], True) if len(own.row) else np.zeros(0, bool)
        end = np.where(last, own.off[own.row + 1], nxt) if len(own.row) else nxt[:0]
        np.add.at(mark, own.start[g], 1)
        np.subtract.at(mark, end[g], 1)
        kept = np.cumsum(mark[:-1], dtype=np.int32) == 0
        total = np.zeros(len(kept) + 1, np.int32)
        np.cumsum(kept, out=total[1:])
        left = total[own.off]
        data = own.data[kept].tobytes()
        parts = pa.array([data[a:b].decode() for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)], pa.string())
        count = lambda pick: np.bincount(own.row[pick], minlength=n)
        return pa.table([id_column(own.ids), count(slice(None)), count(g), np.diff(own.off) - np.diff(left).astype(np.int64), parts], names=names)

    return run


def sentence_span_dedup(docs: DataFrame, length: int = SENTENCES, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, bytes_removed, text) of each row; text is what is kept. length, least: sentences and words of a run, at least."""
    if length < 1 or least < 1:
        raise ValueError("a run has one sentence and one word at least")
    texts, n_shards = sharded(docs)
    n = bucket_count(docs.sparkSession, n_shards)
    by_shard = texts.groupBy("shard")
    told = by_shard.applyInArrow(lean(_tell(n, length, least)), _TOLD)
    said = told.groupBy("bucket").applyInArrow(lean(_first_shard), _TOLD)
    return by_shard.cogroup(said.groupBy("shard")).applyInArrow(lean(_cut(n, length, least)), _RESULT)
