"""Token files: byte-level BPE ids, written as Re-Pair grammars per shard.

``write_token_files`` range-partitions documents by ``doc_id``, encodes each
whole text, appends id 0, and compresses runs of documents ("shards" of about
``SHARD_TOKENS`` ids) by Re-Pair: rounds replace the most frequent adjacent
pairs by new symbols until no pair is left that stands ``LEAST_COUNT`` times,
or rules stop at two bytes a symbol where more of them would not make the file smaller.
A shard stores its rules, the expansion length of every rule, the final symbols
and the token count of each document, so that ``decode_range`` reads any slice
without the rest.  Symbols take two bytes where ids and rules fit, else four.

Order is (doc_id, text); null ids come first; null and empty texts hold the
end id alone; rows with one id are kept apart.  An empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm.common import bytes_of, id_column, int_column, lean, plan_bytes, run_dir, shuffle_partitions, small_batches, spans_of
from caseloom.llm.hashing import blocks_of, eights, sums

END_ID = 0
SHARD_TOKENS = 1 << 20
#: Pairs that one round replaces, the most frequent ones.
RULES_A_ROUND = 1 << 14
#: A pair that stands less often is not worth a rule.
LEAST_COUNT = 24
#: Chunks of text whose ids a worker keeps.
CACHE_ENTRIES = 1_000_000
#: Their bytes and ids, at most.
CACHE_BYTES = 64 << 20
#: Symbols that two bytes tell apart.
NARROW = 1 << 16
MAGIC = b"CLTK2"


# --- Re-Pair -----------------------------------------------------------------


def repair(seq: np.ndarray, first_symbol: int, least: int = LEAST_COUNT, per_round: int = RULES_A_ROUND) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rules[i] is the pair that symbol first_symbol + i stands for."""
    seq = seq.astype(np.uint32)
    rules: list[np.ndarray] = []
    nxt, narrow = first_symbol, None
    while len(seq) > least:
        kind, half = (np.uint32, 16) if nxt <= 1 << 16 else (np.uint64, 32)
        pair = (seq[:-1].astype(kind) << kind(half)) | seq[1:]
        order = np.sort(pair)
        cut = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        count = np.diff(np.append(cut, len(order)))
        good = np.flatnonzero(count >= least)
        room = per_round
        if nxt < NARROW:
            room = min(room, NARROW - nxt)
        elif narrow is None and nxt == NARROW:
            narrow = seq.copy(), len(rules)
        if len(good) > room:
            good = good[np.argsort(-count[good], kind="stable")[:room]]
        chosen = np.sort(order[cut[good]])
        # a small table rejects most positions before the binary search
        sieve = np.zeros(1 << 20, bool)
        fold = lambda p: (p ^ (p >> kind(half - 3))) & kind((1 << 20) - 1)
        sieve[fold(chosen)] = True
        at = np.flatnonzero(sieve[fold(pair)])
        rule = np.searchsorted(chosen, pair[at])
        rule[rule == len(chosen)] = 0
        hit = chosen[rule] == pair[at] if len(chosen) else np.zeros(len(at), bool)
        at, rule = at[hit], rule[hit]
        # in a run of overlapping pairs every other one is replaced, from the left
        start = np.concatenate(([True], np.diff(at) != 1)) if len(at) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - head) % 2 == 0
        at, rule = at[take], rule[take]
        # overlaps may have left a pair too few places
        used = np.flatnonzero(np.bincount(rule, minlength=len(chosen)) >= max(2, least // 2))
        if not len(used):
            break
        name = np.full(len(chosen), -1)
        name[used] = np.arange(len(used))
        at, rule = at[name[rule] >= 0], name[rule[name[rule] >= 0]]
        rules.append(np.stack([chosen[used] >> kind(half), chosen[used] & kind((1 << half) - 1)], 1).astype(np.uint32))
        seq[at] = (nxt + rule).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        nxt += len(used)
    out = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    if narrow is not None:
        # rules past two bytes must save more than four bytes a symbol cost
        few = sum(len(r) for r in rules[: narrow[1]])
        if 2 * len(narrow[0]) + 8 * few <= 4 * len(seq) + 12 * len(out):
            return narrow[0], out[:few]
    return seq, out


def rule_lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    out = np.ones(first_symbol + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[first_symbol + i] = out[a] + out[b]
    return out[first_symbol:]


def expand(symbols: np.ndarray, rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids that symbols stand for; rules are spelt out once, in their order."""
    spelt: list[list[int]] = []
    for a, b in rules.tolist():
        left = [a] if a < first_symbol else spelt[a - first_symbol]
        spelt.append(left + ([b] if b < first_symbol else spelt[b - first_symbol]))
    size = np.ones(first_symbol + len(spelt), np.int32)
    size[first_symbol:] = [len(x) for x in spelt]
    begin = np.cumsum(size) - size
    flat = np.concatenate((np.arange(first_symbol, dtype=np.uint32), np.array([i for x in spelt for i in x], np.uint32)))
    n = size[symbols]
    end = np.cumsum(n)
    if not len(end):
        return np.zeros(0, np.uint32)
    at = np.repeat((begin[symbols] - (end - n)).astype(np.int32), n)
    at += np.arange(end[-1], dtype=np.int32)
    return flat[at]


def _symbol_kind(n_symbols: int) -> str:
    return "<u2" if n_symbols <= 1 << 16 else "<u4"


def pack(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, first_symbol: int) -> bytes:
    """One shard: header, document ids, token counts, rules, expansion lengths, symbols."""
    symbols, rules = repair(ids, first_symbol)
    lengths = rule_lengths(rules, first_symbol)
    kind = _symbol_kind(first_symbol + len(rules))
    head = MAGIC + struct.pack("<IIIQQ", first_symbol, len(doc_ids), len(rules), len(symbols), len(ids))
    return head + b"".join((doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(kind).tobytes()))


class Shard:
    """A packed shard, read without expanding it."""

    def __init__(self, blob: bytes):
        n = len(MAGIC)
        if blob[:n] != MAGIC:
            raise ValueError("not a token shard")
        self.first, docs, rules, symbols, self.n_tokens = struct.unpack_from("<IIIQQ", blob, n)
        at = n + struct.calcsize("<IIIQQ")

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.counts = part("<i8", docs), part("<u4", docs).astype(np.int64)
        kind = _symbol_kind(self.first + rules)
        self.rules, self.lengths = part(kind, 2 * rules).reshape(-1, 2).astype(np.uint32), part("<u4", rules)
        self.symbols = part(kind, symbols)

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.first)

    @functools.cached_property
    def ends(self) -> np.ndarray:
        """Where each symbol's ids end."""
        return np.cumsum(self._width(self.symbols))

    def _width(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        out[rule] = self.lengths[symbols[rule].astype(np.int64) - self.first]
        return out

    def decode_range(self, start: int, stop: int) -> np.ndarray:
        """ids()[start:stop]: goes down from the symbols that cover it, level by level, and leaves aside what lies outside by its length."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left")
        now = self.symbols[i : j + 1].astype(np.int64)
        begin = self.ends[i : j + 1] - self._width(now)
        while (rule := now >= self.first).any():
            size = 1 + rule
            at = np.cumsum(size) - size
            new = np.repeat(now, size)
            pair = self.rules[now[rule] - self.first]
            new[at[rule]], new[at[rule] + 1] = pair[:, 0], pair[:, 1]
            where = np.repeat(begin, size)
            where[at[rule] + 1] += self._width(pair[:, 0])
            inside = (where < stop) & (where + self._width(new) > start)
            now, begin = new[inside], where[inside]
        return now.astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        stop = int(self.counts[: k + 1].sum())
        return self.decode_range(stop - int(self.counts[k]), stop)


# --- encoding ----------------------------------------------------------------


def _odd(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows in which a blank or line end touches another one or the row's edge, or that hold any other white space."""
    n = len(data)
    part = (data == 32) | (data == 10)
    bad = (data < 32) & (data != 10) & (((data > 8) & (data < 14)) | (data > 27))
    touch = part.copy()
    touch[1:] &= part[:-1]
    bad |= touch
    full = off[:-1] < off[1:]
    bad[off[:-1][full]] |= part[off[:-1][full]]
    bad[off[1:][full] - 1] |= part[off[1:][full] - 1]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(lead):
        b0 = data[lead]
        b1 = data[np.minimum(lead + 1, n - 1)]
        b2 = data[np.minimum(lead + 2, n - 1)]
        wide = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        wide |= (b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80)
        wide |= (b0 == 0xE2) & (((b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))) | ((b1 == 0x81) & (b2 == 0x9F)))
        wide |= (b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)
        bad[lead[wide]] = True
    seen = np.zeros(n + 1, np.int64)
    np.cumsum(bad, out=seen[1:])
    return seen[off[1:]] > seen[off[:-1]]


def _flat(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of each range, one after the other."""
    end = np.cumsum(count)
    return np.repeat(begin - (end - count), count) + np.arange(end[-1] if len(end) else 0)


class Encoder:
    """ids of whole texts by the tokenizers library, as ``encode(text, add_special_tokens=False)`` gives them.

    A vocabulary whose pre-tokenizer parts text before each blank that a
    non-blank follows and around a single line end gives a text the ids of its
    blank-separated chunks, one after the other; whether it does is read from
    the loaded tokenizer.  Chunks (with the blank before them) are found by hash
    and compared by their bytes; each distinct one is encoded once and its ids
    kept, up to ``CACHE_ENTRIES`` for a worker.  Texts with other white space,
    with blanks that touch, with a special token's string or with a chunk whose
    hash is another's are encoded as they are, and so are all texts of any
    other vocabulary.
    """

    def __init__(self, path: str):
        # one task has one core: threads of the library's own would only spin
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocab = max(self.tok.get_vocab().values()) + 1
        self.kind = np.uint16 if self.vocab <= 1 << 16 else np.uint32
        #: strings that the library looks for before anything else
        self.special = [x.content.encode() for x in self.tok.get_added_tokens_decoder().values()]
        self.parts = _parts_at_blanks(self.tok)
        self.newline = self.raw(["\n"])[0]
        self.blank = np.zeros(self.vocab, bool)
        self.blank[[i for t, i in self.tok.get_vocab().items() if t.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, self.kind)
        #: bytes of each kept chunk in blocks of eight: where they begin, and how many bytes
        self.text_at, self.text_size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.text = np.zeros(0, np.uint64)

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray, after_blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of unseen chunks: (flat, begin, count). Those after a blank are encoded in long runs, parted where a token opens with a blank."""
        flat: list[np.ndarray] = []
        count = np.zeros(len(h), np.int64)
        order = np.concatenate((np.flatnonzero(after_blank), np.flatnonzero(~after_blank)))
        n = int(after_blank.sum())
        for i in range(0, n, 1024):
            pick = order[i : min(i + 1024, n)]
            run = data[_flat(s[pick] - 1, e[pick] - s[pick] + 1)].tobytes().decode()
            ids = self.raw([run])[0]
            cut = np.flatnonzero(self.blank[ids])
            if len(cut) != len(pick):
                got = self.raw([data[a - 1 : b].tobytes().decode() for a, b in zip(s[pick], e[pick], strict=True)])
                count[pick] = [len(x) for x in got]
                flat += got
            else:
                count[pick] = np.diff(np.append(cut, len(ids)))
                flat.append(ids)
        rest = order[n:]
        got = self.raw([data[a:b].tobytes().decode() for a, b in zip(s[rest], e[rest], strict=True)])
        count[rest] = [len(x) for x in got]
        flat += got
        begin = np.zeros(len(h), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return (np.concatenate(flat) if flat else np.zeros(0, self.kind)), begin, count

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows, one after the other, and how many each row has."""
        n = len(off) - 1
        odd = np.ones(n, bool) if not self.parts else _odd(data, off) if len(data) else np.zeros(n, bool)
        raw = data.tobytes()
        for x in self.special:
            at = raw.find(x)
            while at >= 0:
                odd[np.searchsorted(off, at, "right") - 1] = True
                at = raw.find(x, at + 1)
        return self._encode(data, off, odd)

    def _encode(self, data: np.ndarray, off: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(off) - 1
        out = np.zeros(n, np.int64)
        part = (data == 32) | (data == 10)
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        first = ~part
        last = first.copy()
        first[1:] &= part[:-1] | edge[1:-1]
        last[:-1] &= part[1:] | edge[1:-1]
        s = np.flatnonzero(first)
        e = np.flatnonzero(last) + 1
        row = np.searchsorted(off, s, "right") - 1
        ok = ~odd[row]
        s, e, row = s[ok], e[ok], row[ok]
        inner = s > off[row]
        sep = data[s - 1] if len(s) else np.zeros(0, np.uint8)
        tail = inner & (sep == 32)
        line = inner & (sep == 10)
        size = (2 * (e - s) + tail).astype(np.int32)  # of a chunk, and whether a blank is before it
        at, place, mask, block = blocks_of(s, e)
        x = np.take(eights(data), at)
        x &= mask
        h = sums(x, place, block, size) if len(s) else np.zeros(0, np.uint64)
        u, first_at, inv = np.unique(h, return_index=True, return_inverse=True)
        k = np.searchsorted(self.hash, u)
        k[k == len(self.hash)] = 0
        known = self.hash[k] == u if len(self.hash) else np.zeros(len(u), bool)
        # a chunk is what its hash says only if its bytes are too
        other = _differ(x, block, size, x, block[first_at][inv], size[first_at][inv], place)
        if known.any():
            rep = np.flatnonzero(known)
            width = _blocks(size[first_at[rep]])
            mine = _flat(block[first_at[rep]], width)
            begin = np.cumsum(width) - width
            wrong = np.zeros(len(u), bool)
            wrong[rep] = _differ(x[mine], begin, size[first_at[rep]], self.text, self.text_at[k[rep]].astype(np.int64), self.text_size[k[rep]], place[mine])
            other |= wrong[inv]
        if other.any():
            odd = odd.copy()
            odd[row[other]] = True
            return self._encode(data, off, odd)
        begin, count = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        begin[known], count[known] = self.begin[k[known]], self.count[k[known]]
        new = np.flatnonzero(~known)
        flat = self.flat
        if len(new):
            f = first_at[new]
            got, b, c = self._learn(data, u[new], s[f], e[f], tail[f])
            begin[new], count[new] = b + len(flat), c
            flat = np.concatenate((flat, got))
            if len(self.hash) + len(new) <= CACHE_ENTRIES and 8 * len(self.text) + int(size[f].sum()) + flat.nbytes <= CACHE_BYTES:
                where = np.searchsorted(self.hash, u[new])
                width = _blocks(size[f])
                self.hash = np.insert(self.hash, where, u[new])
                self.begin = np.insert(self.begin, where, begin[new].astype(np.int32))
                self.count = np.insert(self.count, where, c.astype(np.int32))
                self.text_at = np.insert(self.text_at, where, (len(self.text) + np.cumsum(width) - width).astype(np.int32))
                self.text_size = np.insert(self.text_size, where, size[f])
                self.text = np.concatenate((self.text, x[_flat(block[f], width)]))
                self.flat = flat
        # a line end before a chunk is one more id
        c = count[inv]
        size = c + line * len(self.newline)
        out += np.bincount(row, size, n).astype(np.int64)
        ids = np.empty(int(size.sum()), self.kind)
        end = np.cumsum(size)
        ids[_flat(end - c, c)] = flat[_flat(begin[inv], c)]
        for i, y in enumerate(self.newline):
            ids[(end - size)[line] + i] = y
        if odd.any():
            rows = np.flatnonzero(odd)
            got = self.raw([data[off[r] : off[r + 1]].tobytes().decode() for r in rows])
            cut = np.concatenate(([0], np.cumsum(out)))
            mine = dict(zip(rows.tolist(), got, strict=True))
            ids = np.concatenate([mine[r] if r in mine else ids[cut[r] : cut[r + 1]] for r in range(n)])
            out[rows] = [len(y) for y in got]
        return ids, out


def _blocks(size: np.ndarray) -> np.ndarray:
    """Blocks of eight bytes of chunks of such ``size`` (twice their bytes, and the blank)."""
    return np.maximum(((size >> 1) + 7) >> 3, 1).astype(np.int64)


def _differ(x: np.ndarray, begin: np.ndarray, size: np.ndarray, y: np.ndarray, y_begin: np.ndarray, y_size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which ranges of blocks of x are not those of y; all blocks of x stand in order."""
    if not len(begin):
        return np.zeros(0, bool)
    other = np.repeat(y_begin, np.diff(np.append(begin, len(x)))) + place
    unlike = x != y[np.minimum(other, len(y) - 1)]
    return np.logical_or.reduceat(unlike, begin) | (size != y_size)


def _parts_at_blanks(tok) -> bool:
    """Whether the tokenizer is byte-level BPE, parted by the usual pattern, without a normalizer or leading blank."""
    import json

    said = json.loads(tok.to_str())
    pre = said.get("pre_tokenizer") or {}
    return said.get("normalizer") is None and said["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", False)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


SHARD_SCHEMA = "part int, seq int, before long, n_docs int, n_tokens long, payload binary"


def _writer(path: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(path)
        buf: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = seq = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, seq, before
            tokens, count, who = np.concatenate(buf), np.concatenate(counts), np.concatenate(ids)
            blob = pack(tokens, who, count, enc.vocab)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(count)], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([blob], pa.binary())],
                ["part", "seq", "before", "n_docs", "n_tokens", "payload"],
            )
            seq, before, held = seq + 1, before + len(tokens), 0
            buf.clear(), ids.clear(), counts.clear()
            return row

        for batch in batches:
            who, (data, off) = int_column(batch, "doc_id"), bytes_of(batch.column("text"))
            for i, j in spans_of(off, 1 << 20):
                got, count = enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                end = np.cumsum(count)
                full = np.insert(got, end, END_ID)
                buf.append(full)
                ids.append(who[i:j])
                counts.append(count + 1)
                held += len(full)
                if held >= shard_tokens:
                    yield flush()
        if counts:
            yield flush()

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, shard_tokens: int = SHARD_TOKENS, partition_bytes: int | None = None) -> None:
    """Writes the table of shards (``SHARD_SCHEMA``) of all documents under ``out``, in doc_id order.

    A partition has ``partition_bytes`` of Parquet: 8 MB, or ``spark.caseloom.shardBytes`` where that is more.
    """
    partition_bytes = partition_bytes or max(8 << 20, int(docs.sparkSession.conf.get("spark.caseloom.shardBytes", "0")))
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    n = max(shuffle_partitions(docs.sparkSession), -(-plan_bytes(base) // partition_bytes))
    ranged = base.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ranged.mapInArrow(lean(_writer(tokenizer_path, shard_tokens)), SHARD_SCHEMA).write.mode("overwrite").parquet(out)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            shard = Shard(batch.column("payload")[r].as_buffer().to_pybytes())
            raw = shard.ids().astype("<u4")
            end = np.cumsum(shard.counts)
            start = end - shard.counts
            data = memoryview(raw.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [id_column(shard.doc_ids), pa.array(np.full(len(crc), batch.column("part")[r].as_py(), np.int32)), pa.array(start + batch.column("before")[r].as_py(), pa.int64()), pa.array(shard.counts, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "part", "at", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone.

    Parts are counted, not documents: their running total is a table with one
    row for each partition that was written.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    rows = shards.select("part", "before", "payload").mapInArrow(lean(_reader), "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(parts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, out: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    out = out or run_dir(spark, "token-files")
    write_token_files(docs, out, tokenizer_path)
    return read_token_files(spark, out)


__all__ = ["Encoder", "Shard", "expand", "pack", "read_token_files", "repair", "token_output", "write_token_files"]
