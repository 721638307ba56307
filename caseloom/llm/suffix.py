"""Substring deduplication by longest-previous-factor arrays.

Removes every byte that lies in a string of ``LENGTH`` bytes which also starts
earlier (smaller doc_id, or the same document, earlier): those begin where the
longest previous factor (LPF) reaches LENGTH.  ``lpf`` finds it from the
previous and next smaller positions in suffix order, as the longest factor that
also starts earlier begins at one of these two.

No suffix array of the whole corpus is built; it falls into parts that share
nothing of LENGTH bytes:

1. Windows of LENGTH bytes are grouped, by content alone, under the smallest
   hash of their K-byte strings; a unit is a run of windows under one such
   anchor.  Shards send the distinct (anchor, unit) names to buckets.
2. A bucket says which units an earlier shard has (all their windows repeat),
   and which anchors have several units: only there can windows of different
   units be equal.  A name is 96 bits of hash, and the bucket's some more.
3. First copies of such units go, with their bytes, to a bucket of their
   anchor, where suffixes are put in order, cut at LENGTH bytes, compared with
   their neighbours byte by byte, and judged by their LPF.  Anchors with many
   units ("hot") send names of windows (128 bits) instead, which spread over all
   buckets, so no bucket holds more of them than of others.

Rows: null text counts as empty; texts under LENGTH bytes lose nothing; equal
rows are compared in (doc_id, text) order, so the later of two equal rows with
one id goes; null ids come first; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caseloom.llm.common import bucket_count, bytes_of, id_column, in_order, int_column, lean, sharded, spans_of
from caseloom.llm.hashing import eights, fixed, mix, ranges, sums, window_min

LENGTH = 100
K = 50
SPAN = LENGTH - K + 1  # K-byte strings in a window
#: Longest run of windows in a unit; a longer one is cut.
UNIT_WINDOWS = 2048
#: Anchors with more distinct units than this send window hashes.
HOT_UNITS = 2048
U = np.uint64
_LOW = U(0xFFFFFFFF)


# --- arrays ------------------------------------------------------------------


def _rank(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    new = np.zeros(len(key), np.uint64)
    new[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(new)
    return out


def ranks(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of the bytes codes[s : s + length] among those of all starts; equal strings, equal rank.

    Prefix doubling, begun with eight bytes as one number; ranks of fewer than
    2**21 strings are put together three at a time. ``codes`` must reach
    ``length`` past every start.
    """
    assert not len(starts) or (length >= 8 and starts.max() + length <= len(codes))
    key = np.zeros(max(0, len(codes) - 7), np.uint64)
    for i in range(8):
        key = (key << U(8)) | codes[i : len(codes) - 7 + i]
    have = 8
    rank = _rank(key)
    while have * 2 <= length:
        step = 3 if len(rank) < 1 << 21 and have * 3 <= length else 2
        bits = U(21 if step == 3 else 32)
        m = len(rank) - have * (step - 1)
        key = rank[:m]
        for i in range(1, step):
            key = (key << bits) | rank[have * i : have * i + m]
        rank = _rank(key)
        have *= step
    return _rank((rank[starts] << U(32)) | rank[starts + length - have])


def common_prefix(codes: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that codes[a:] and codes[b:] share at their start, ``length`` at most (8 or more)."""
    view = eights(codes)
    out = np.full(len(a), length, np.int64)
    left = np.arange(len(a))
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        x = view[a[left] + at] ^ view[b[left] + at]
        here = np.flatnonzero(x)
        low = x[here] & (~x[here] + U(1))  # lowest bit that differs: a power of two, exact as a float
        out[left[here]] = at + (np.frexp(low.astype(np.float64))[1] - 1) // 8
        left = left[x == 0]
    return out


def _smaller_before(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the nearest one before it in suffix order that starts earlier in the text.

    Every suffix points at a candidate before it, with the common prefix up to
    there; one that starts later hands on its own.
    """
    start = np.append(sa, -1)  # past the first is nothing
    to, common = np.arange(len(sa)) - 1, lcp.copy()
    left = np.arange(len(sa))
    while True:
        left = left[start[to[left]] > sa[left]]
        if not len(left):
            return common
        by = to[left]
        common[left], to[left] = np.minimum(common[left], common[by]), to[by]


def lpf(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each position; lcp[i] is the common prefix of suffixes sa[i - 1] and sa[i], lcp[0] is 0."""
    out = np.zeros(len(sa), np.int64)
    if len(sa):
        after = np.append(0, lcp[:0:-1])
        out[sa] = np.maximum(_smaller_before(sa, lcp), _smaller_before(sa[::-1], after)[::-1])
    return out


def repeats(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which starts have LPF >= length among these starts, which are given in text order."""
    order = np.argsort(ranks(codes, starts, length), kind="stable")
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = common_prefix(codes, starts[order[:-1]], starts[order[1:]], length)
    return lpf(order, lcp) >= length


# --- units -------------------------------------------------------------------


def _units(data: np.ndarray, off: np.ndarray):
    size = np.diff(off)
    long = np.flatnonzero(size >= LENGTH)
    z = np.zeros(0, np.int64)
    if not len(long):
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(bool)
    h = fixed(data, K)
    low = window_min(h, SPAN)  # of window j: smallest hash of its K-byte strings
    lo, hi = off[long], off[long + 1] - LENGTH + 1
    cut = np.flatnonzero(low[1:] != low[:-1]) + 1
    cut = np.unique(np.concatenate((cut, lo, hi)))
    row = np.searchsorted(lo, cut, "right") - 1
    ok = (row >= 0) & (cut < hi[np.maximum(row, 0)])
    nxt = np.append(cut[1:], len(low))
    s, e = cut[ok], np.minimum(nxt[ok], hi[row[ok]])
    wide = np.flatnonzero(e - s > UNIT_WINDOWS)
    if len(wide):
        more_s = np.concatenate([np.arange(s[i], e[i], UNIT_WINDOWS) for i in wide])
        more_e = np.minimum(more_s + UNIT_WINDOWS, np.concatenate([np.full(-(-(e[i] - s[i]) // UNIT_WINDOWS), e[i]) for i in wide]))
        keep = np.ones(len(s), bool)
        keep[wide] = False
        s, e = np.concatenate((s[keep], more_s)), np.concatenate((e[keep], more_e))
        order = np.argsort(s)
        s, e = s[order], e[order]
    anchor = low[s]
    # an anchor that occurs twice among a unit's bytes: windows may repeat inside it
    hit = np.flatnonzero(h == anchor_at(low, len(h)))
    lo, hi = np.searchsorted(hit, s), np.searchsorted(hit, e + SPAN - 1)
    n = hi - lo  # at least the anchor itself
    end = np.cumsum(n)
    same = h[hit][np.repeat(lo - (end - n), n) + np.arange(end[-1])] == np.repeat(anchor, n)
    inside = np.add.reduceat(same, end - n, dtype=np.int64)
    return s, e, anchor, _names(h, s, e + LENGTH - 1), inside > 1


def _names(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Of byte ranges of K and more, from the hashes of their K-byte strings side by side and of their last one."""
    count = (e - s) // K + 1
    begin = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(begin, count)
    at = np.repeat(s, count) + K * place
    at[begin + count - 1] = e - K
    return sums(h[at], place, begin, e - s)


def _window_names(data: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window, straight from its bytes."""
    parts = [[ranges(data, w[i : i + (1 << 15)], w[i : i + (1 << 15)] + LENGTH, seed) for i in range(0, len(w), 1 << 15)] for seed in (1, 2)]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in parts)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Places of the first row of each distinct tuple, by tuple."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    return order[new]


def units(data: np.ndarray, off: np.ndarray):
    """Units of concatenated rows: first window, last window + 1, anchor, content hash, and whether it may repeat itself.

    Rows are taken a few hundred kilobytes at a time, which fit the cache.
    """
    parts = []
    for i, j in spans_of(off, 1 << 18):
        s, e, *rest = _units(data[off[i] : off[j]], off[i : j + 1] - off[i])
        parts.append((s + off[i], e + off[i], *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else _units(data, off)


def anchor_at(low: np.ndarray, n: int) -> np.ndarray:
    """For each K-byte string, the smallest anchor of the windows over it: it is an anchor itself if it equals that."""
    full = np.full(n + SPAN - 1, np.iinfo(np.uint64).max, np.uint64)
    full[SPAN - 1 : SPAN - 1 + len(low)] = ~low
    return ~window_min(full, SPAN)[:n]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) % U(n)).astype(np.int64)


class ShardUnits:
    """The units of a shard's rows in (doc_id, text) order, and their distinct (anchor, unit) hashes by bucket.

    A unit that may repeat itself also gives a hash of its own kind, so that its
    anchor never has one unit alone.
    """

    def __init__(self, table: pa.Table, n_buckets: int):
        data, off = bytes_of(table["text"])
        self.ids, self.data, self.off = in_order(int_column(table, "doc_id"), data, off)
        self.s, self.e, self.anchor, unit, selfish = units(self.data, self.off)
        # one 64-bit name for the pair keeps the sort short
        bucket = bucket_of(self.anchor, n_buckets)
        own = np.flatnonzero(selfish)
        a = np.concatenate((self.anchor, self.anchor[own]))
        u = np.concatenate((unit, mix(unit[own] + U(1))))
        b = np.concatenate((bucket, bucket[own]))
        order = np.lexsort((u, a & _LOW, b))
        a, u, b = (a[order] & _LOW).astype(np.uint32), u[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (u[1:] != u[:-1]) | (b[1:] != b[:-1])
        self.key_anchor, self.key_unit, self.key_bucket = a[new], u[new], b[new]
        name = np.empty(len(order), np.int64)
        name[order] = np.cumsum(new) - 1
        self.key = name[: len(self.s)]  # of each unit

    def messages(self) -> tuple[np.ndarray, list[bytes]]:
        b, at = np.unique(self.key_bucket, return_index=True)
        at = np.append(at, len(self.key_bucket))
        return b, [self.key_anchor[i:j].astype("<u4").tobytes() + self.key_unit[i:j].astype("<u8").tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]

    def answers(self, table: pa.Table, kind: int) -> np.ndarray:
        """What the buckets said of each distinct hash."""
        out = np.zeros(len(self.key_bucket), np.uint8)
        if table is None or table.num_rows == 0:
            return out
        at = np.searchsorted(self.key_bucket, np.arange(self.key_bucket.max(initial=0) + 2))
        for k, b, blob in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["blob"].to_pylist(), strict=True):
            if k == kind:
                out[at[b] : at[b + 1]] = np.frombuffer(blob, np.uint8)
        return out


REPEAT, ASK, HOT = 1, 2, 4
_MESSAGE = "bucket int, shard int, blob binary"
_ANSWER = "shard int, kind int, bucket int, blob binary"


def _rows(schema: str, *columns) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _judge(hot_units: int):
    def run(table: pa.Table) -> pa.Table:
        """In one bucket: which units an earlier shard has, and which anchors have several."""
        shard = np.array(table["shard"].to_pylist())
        order = np.argsort(shard, kind="stable")
        blobs = table["blob"].to_pylist()
        count = np.array([len(blobs[i]) // 12 for i in order])
        a = np.concatenate([np.frombuffer(blobs[i], "<u4", len(blobs[i]) // 12) for i in order])
        u = np.concatenate([np.frombuffer(blobs[i], "<u8", len(blobs[i]) // 12, len(blobs[i]) // 3) for i in order])
        del blobs
        by = np.lexsort((u, a))  # stable: of equal units the earlier shard first
        sa, su = a[by], u[by]
        new_a = np.ones(len(by), bool)
        new_a[1:] = sa[1:] != sa[:-1]
        new = new_a.copy()
        new[1:] |= su[1:] != su[:-1]
        group = np.cumsum(new_a) - 1
        kinds = np.bincount(group, weights=new).astype(np.int64)[group]
        say = np.where(new, np.where(kinds > 1, ASK, 0) | np.where(kinds > hot_units, HOT, 0), REPEAT).astype(np.uint8)
        out = np.empty(len(by), np.uint8)
        out[by] = say
        end = np.cumsum(count)
        n = len(order)
        b = table["bucket"][0].as_py()
        return _rows(_ANSWER, shard[order].tolist(), [0] * n, [b] * n, [out[j - c : j].tobytes() for c, j in zip(count.tolist(), end.tolist(), strict=True)])

    return run


def _asked(own: ShardUnits, say: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per unit: its answer, and whether it is its shard's first with that hash."""
    first = np.zeros(len(own.key), bool)
    first[np.unique(own.key, return_index=True)[1]] = True
    return say[own.key] if len(own.key) else np.zeros(0, np.uint8), first


def _split(bucket: np.ndarray, order_key: np.ndarray):
    order = np.lexsort((order_key, bucket))
    b, at = np.unique(bucket[order], return_index=True)
    at = np.append(at, len(order))
    return [(int(x), order[i:j]) for x, i, j in zip(b, at[:-1], at[1:], strict=True)]


def _show(n_buckets: int):
    """From a shard's first copies: bytes of asked units to their anchor's bucket, window hashes of hot ones to the windows' buckets."""

    def run(key, texts: pa.Table, said: pa.Table) -> pa.Table:
        if texts.num_rows == 0:
            return _rows(_MESSAGE, [], [], [])
        own = ShardUnits(texts, n_buckets)
        say, first = _asked(own, own.answers(said, 0))
        shard = key[0].as_py()
        buckets, blobs = [], []
        cold = np.flatnonzero(first & (say == ASK))
        for b, pick in _split(bucket_of(own.anchor[cold], n_buckets), cold):
            u = cold[pick]
            size = (own.e[u] + LENGTH - 1 - own.s[u]).astype("<u4")
            raw = own.data.tobytes() if len(u) > 64 else own.data
            text = b"".join(bytes(raw[i : i + n]) for i, n in zip(own.s[u].tolist(), size.tolist(), strict=True))
            buckets.append(b)
            blobs.append(b"C" + np.uint32(len(u)).tobytes() + u.astype("<u4").tobytes() + size.tobytes() + own.anchor[u].astype("<u8").tobytes() + text)
        hot = np.flatnonzero(first & (say == (ASK | HOT)))
        if len(hot):
            n = own.e[hot] - own.s[hot]
            w = np.repeat(own.s[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            h, g = _window_names(own.data, w)
            at = _firsts(h, g)  # first start of each in the shard
            h, g, w = h[at], g[at], w[at]
            for b, pick in _split(bucket_of(h, n_buckets), w):
                buckets.append(b)
                blobs.append(b"W" + h[pick].astype("<u8").tobytes() + g[pick].astype("<u8").tobytes() + w[pick].astype("<u4").tobytes())
        return _rows(_MESSAGE, buckets, [shard] * len(buckets), blobs)

    return run


def _find(table: pa.Table) -> pa.Table:
    """In one bucket: windows that also start in an earlier unit (LPF), and window hashes that an earlier shard has."""
    shard = table["shard"].to_pylist()
    blobs = table["blob"].to_pylist()
    bucket = table["bucket"][0].as_py()
    order = sorted(range(len(shard)), key=lambda i: shard[i])
    out_shard, out_blob, kinds = [], [], []
    unit, size, anchor, owner, text = [], [], [], [], []
    hh, hg, hw, hs = [], [], [], []
    for i in order:
        blob = blobs[i]
        if blob[:1] == b"C":
            n = int(np.frombuffer(blob, "<u4", 1, 1)[0])
            unit.append(np.frombuffer(blob, "<u4", n, 5))
            size.append(np.frombuffer(blob, "<u4", n, 5 + 4 * n))
            anchor.append(np.frombuffer(blob, "<u8", n, 5 + 8 * n))
            owner.append(np.full(n, shard[i]))
            text.append(blob[5 + 16 * n :])
        else:
            n = (len(blob) - 1) // 20
            hh.append(np.frombuffer(blob, "<u8", n, 1))
            hg.append(np.frombuffer(blob, "<u8", n, 1 + 8 * n))
            hw.append(np.frombuffer(blob, "<u4", n, 1 + 16 * n))
            hs.append(np.full(n, shard[i]))
    if unit:
        unit, size, anchor, owner = np.concatenate(unit), np.concatenate(size).astype(np.int64), np.concatenate(anchor), np.concatenate(owner)
        data = np.frombuffer(b"".join(text), np.uint8)
        found_unit, found_from = [], []
        begin = np.cumsum(size) - size
        # whole anchors at a time, some megabytes each, in the order of shard and unit
        by = np.argsort(anchor, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], anchor[by][1:] != anchor[by][:-1])))
        ends = np.cumsum(size[by])
        i = 0
        while i < len(edge):
            base = ends[edge[i]] - size[by[edge[i]]]
            j = i + 1
            while j < len(edge) and ends[edge[j] - 1] - base < (1 << 20):
                j += 1
            pick = by[edge[i] : edge[j] if j < len(edge) else len(by)]
            i = j
            n = size[pick]
            at = np.cumsum(n) - n
            codes = data[np.repeat(begin[pick] - at, n) + np.arange(n.sum())]
            windows = n - LENGTH + 1
            first = np.cumsum(windows) - windows
            which = np.repeat(np.arange(len(pick)), windows)
            starts = np.repeat(at - first, windows) + np.arange(windows.sum())
            hit = repeats(codes, starts, LENGTH)
            found_unit.append(pick[which[hit]])
            found_from.append((starts - at[which])[hit])
        fu, ff = np.concatenate(found_unit), np.concatenate(found_from)
        for s in np.unique(owner[fu]):
            mine = owner[fu] == s
            out_shard.append(int(s))
            kinds.append(1)
            out_blob.append(unit[fu[mine]].astype("<u4").tobytes() + ff[mine].astype("<u4").tobytes())
    if hh:
        h, g, w, s = np.concatenate(hh), np.concatenate(hg), np.concatenate(hw), np.concatenate(hs)
        again = np.ones(len(h), bool)
        again[_firsts(h, g)] = False
        for x in np.unique(s[again]):
            mine = again & (s == x)
            out_shard.append(int(x))
            kinds.append(2)
            out_blob.append(w[mine].astype("<u4").tobytes())
    n = len(out_shard)
    return _rows(_ANSWER, out_shard, kinds, [bucket] * n, out_blob)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(n_buckets: int, with_text: bool):
    def run(key, texts: pa.Table, said: pa.Table) -> pa.Table:
        kinds = _RESULT + (", kept binary" if with_text else "")
        if texts.num_rows == 0:
            return _rows(kinds, *[[] for _ in kinds.split(", ")])
        own = ShardUnits(texts, n_buckets)
        say, first = _asked(own, own.answers(said, 0))
        n = len(own.data)
        kind = np.int32 if n < 1 << 31 else np.int64
        mark = np.zeros(n + 1, kind)  # +1 where a removed stretch begins, -1 past its end
        whole = np.flatnonzero((say == REPEAT) | ~first)
        np.add.at(mark, own.s[whole], 1)
        np.subtract.at(mark, own.e[whole] + LENGTH - 1, 1)
        hot = np.flatnonzero(first & (say == (ASK | HOT)))
        if len(hot):  # windows of hot units that occur earlier in this shard
            c = own.e[hot] - own.s[hot]
            w = np.repeat(own.s[hot] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            later = np.ones(len(w), bool)
            later[_firsts(*_window_names(own.data, w))] = False
            np.add.at(mark, w[later], 1)
            np.subtract.at(mark, w[later] + LENGTH, 1)
            away = [np.frombuffer(b, "<u4") for k, b in zip(said["kind"].to_pylist(), said["blob"].to_pylist(), strict=True) if k == 2]
            if away:
                gone = np.unique(np.concatenate(away).astype(np.int64))
                np.add.at(mark, gone, 1)
                np.subtract.at(mark, gone + LENGTH, 1)
        for k, blob in zip(said["kind"].to_pylist(), said["blob"].to_pylist(), strict=True):
            if k == 1:
                m = len(blob) // 8
                at = own.s[np.frombuffer(blob, "<u4", m)] + np.frombuffer(blob, "<u4", m, 4 * m)
                np.add.at(mark, at, 1)
                np.subtract.at(mark, at + LENGTH, 1)
        gone = np.cumsum(mark[:n], dtype=kind) > 0
        del mark
        off = own.off
        total = np.zeros(n + 1, kind)
        np.cumsum(gone, out=total[1:])
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        inner = off[:-1][np.diff(off) > 0]
        head[inner] = gone[inner]
        spans = np.zeros(n + 1, kind)
        np.cumsum(head, out=spans[1:])
        kept = own.data[~gone].tobytes()
        left = off - total[off]
        parts = [kept[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
        cols = [id_column(own.ids), np.diff(off), np.diff(total[off]).astype(np.int64), np.diff(spans[off]).astype(np.int64), [hashlib.sha256(p).hexdigest() for p in parts]]
        return _rows(kinds, *cols, *([parts] if with_text else []))

    return run


def substring_dedup(docs: DataFrame, with_text: bool = False, hot_units: int = HOT_UNITS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row."""
    texts, n = sharded(docs)
    n_buckets = bucket_count(docs.sparkSession, n)

    def tell(table: pa.Table) -> pa.Table:
        b, blobs = ShardUnits(table, n_buckets).messages()
        return _rows(_MESSAGE, b, np.full(len(b), table["shard"][0].as_py()), blobs)

    by_shard = texts.groupBy("shard")
    judged = by_shard.applyInArrow(lean(tell), _MESSAGE).groupBy("bucket").applyInArrow(lean(_judge(hot_units)), _ANSWER)
    shown = by_shard.cogroup(judged.groupBy("shard")).applyInArrow(lean(_show(n_buckets)), _MESSAGE)
    found = shown.groupBy("bucket").applyInArrow(lean(_find), _ANSWER)
    answers = judged.unionByName(found)
    result = _RESULT + (", kept binary" if with_text else "")
    return by_shard.cogroup(answers.groupBy("shard")).applyInArrow(lean(_cut(n_buckets, with_text)), result)
