"""Conversation prefix tries, built as burst tries.

A turn is an id of 20 bytes: 128 bits of the SHA-256 of role and text, and the
text's length in UTF-8 bytes.  A conversation is the string of its turn ids;
equal ones become one entry with a count, their smallest conv_id and the digest
of their ids.

Entries are suffix containers under trie heads.  At first the root is the only
head.  A container with over ``CONTAINER`` entries bursts by its next turn id:
its prefix becomes a head, its entries go to the containers below.  Rounds look
1, 2, 4, ... levels ahead, so a long common prefix costs few rounds, and a round
reads only entries under heads that are still at its edge.  Heads number at most
turns / limit, and the limit grows so that this stays under ``HEADS``: they are
the only thing that every task gets.  What remains are containers of bounded
size, dealt over shards, sorted by turn ids, and swept: a stack holds one path,
a node is written when its parent closes.  Heads are summed from the tops of
their containers.

Rows: a null role or text is empty; turns of one conversation are ordered by
turn (null first), then role, then the hash of role and text; repeated rows are
repeated turns; rows with a null conv_id belong to no conversation and are left
out; an empty table has no nodes, not even a root; other columns are ignored.
One conversation's turn ids are one row (20 bytes a turn), whatever its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import lean, run_dir, shuffle_partitions, small_batches

#: Bytes of a turn id; the last four are the text's length.
TURN = 20
#: Entries that a container holds before it bursts.
CONTAINER = 256
#: Heads that tasks may be sent; where turns / CONTAINER is more, containers hold more.
HEADS = 1_000_000
#: Bytes of joined conv_ids that travel as one row.
CHUNK = 1 << 16
ROOT = b"root"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def family(conv_id="conv_id"):
    """The conversation whose first turns a conversation starts with."""
    return F.col(conv_id) - F.col(conv_id) % 5


def shared_turns(conv_id="conv_id"):
    """How many turns it takes from there."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % 9).cast("int")


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length keeps role and text apart
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    size = F.lpad(F.hex(F.octet_length(text)), 8, "0")
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.concat(F.lower(digest), size).alias("id")).alias("t")
    )


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, packed binary): the turn ids of each conversation in order."""
    own = _turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.unhex(F.array_join(F.col("t.id"), "")).alias("packed"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, packed): each conversation c as the first h turns of conversation c - c % 5, then its own after its first h; h is crc32(c) % 9.

    One shuffle brings each family of five together.
    """
    turns = _turns(conversations).withColumn("b", family())
    own = turns.repartition("b").groupBy("b", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("b", "conv_id", F.col("t.id").alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("b"), F.slice("own", 1, 8))).alias("first")
    one = own.groupBy("b").agg(first, F.collect_list(F.struct("conv_id", "own")).alias("m")).select("first", F.inline("m"))
    h = shared_turns()
    none = F.array().cast("array<string>")
    both = F.concat(F.slice(F.coalesce("first", none), F.lit(1), h), F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1))))
    return one.select("conv_id", F.unhex(F.array_join(both, "")).alias("packed"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (whole, conv_id) to chunks of joined ids; a chunk is a row, the first of a whole carries its turns."""
    whole, ids, size, turns, first = None, [], 0, None, 0
    for batch in batches:
        out: list[tuple] = []
        for w, c, p in zip(batch["whole"].to_pylist(), batch["conv_id"].to_pylist(), batch["packed"].to_pylist(), strict=True):
            if w != whole or size > CHUNK:
                if ids:
                    out.append((whole, first, len(ids), ",".join(ids), turns))
                turns = p if w != whole else None
                whole, first, ids, size = w, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        yield from _rows(out, _RUNS)
    if ids:
        yield from _rows([(whole, first, len(ids), ",".join(ids), turns)], _RUNS)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (whole, first) to one entry for each whole; the digest is fed chunk by chunk."""
    whole, digest, n, least, turns = None, None, 0, 0, None
    for batch in batches:
        out = []
        for row in zip(*(batch[c].to_pylist() for c in _RUNS), strict=True):
            if row[0] != whole:
                if whole is not None:
                    out.append((turns, n, least, digest.hexdigest()))
                whole, digest, n, least, turns = row[0], hashlib.sha256(), 0, row[1], None
            else:
                digest.update(b",")
            digest.update(row[3].encode())
            n += row[2]
            turns = row[4] if turns is None else turns
        yield from _rows(out, _ENTRY)
    if whole is not None:
        yield from _rows([(turns, n, least, digest.hexdigest())], _ENTRY)


_RUNS = {"whole": pa.binary(), "first": pa.int64(), "n": pa.int64(), "ids": pa.string(), "packed": pa.binary()}
_ENTRY = {"packed": pa.binary(), "n": pa.int64(), "conv_id": pa.int64(), "ends": pa.string()}
_PLACED = {"container": pa.binary(), "depth": pa.int32(), "head": pa.binary()} | _ENTRY
_NODE = {"conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "head": pa.binary()}
_KINDS = {pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}


def _ddl(fields: dict) -> str:
    return ", ".join(f"`{k}` {_KINDS[v]}" for k, v in fields.items())


def _rows(rows: list[tuple], fields: dict) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], list(fields))


def entries(seqs: DataFrame) -> DataFrame:
    """(packed, n, conv_id, ends): one row for each distinct sequence of (conv_id, packed).

    Copies are sorted over all tasks; only chunks of their joined ids meet in one.
    """
    spark = seqs.sparkSession
    path = run_dir(spark, "turns")
    seqs.select("conv_id", "packed", F.unhex(F.substring(F.sha2("packed", 256), 1, 32)).alias("whole")).write.parquet(path)
    kept = spark.read.schema("conv_id long, packed binary, whole binary").parquet(path)
    runs = kept.repartitionByRange(shuffle_partitions(spark), "whole", "conv_id").sortWithinPartitions("whole", "conv_id").mapInArrow(lean(_runs), _ddl(_RUNS))
    return runs.repartition("whole").sortWithinPartitions("whole", "first").mapInArrow(lean(_entries), _ddl(_ENTRY))


def _keys(packed: bytes, lo: int, hi: int) -> list[bytes]:
    """Keys of the prefixes of lo to hi turns."""
    if lo == 0:
        h, out = hashlib.blake2b(digest_size=16), [ROOT]
    else:
        h = hashlib.blake2b(packed[: TURN * lo], digest_size=16)
        out = [h.digest()]
    for d in range(lo, min(hi, len(packed) // TURN)):
        h = h.copy()
        h.update(packed[TURN * d : TURN * (d + 1)])
        out.append(h.digest())
    return out


_LEVELS = {"key": pa.binary(), "parent": pa.binary(), "depth": pa.int32(), "size": pa.int64(), "n": pa.int64()}


def _levels(edge: set[bytes], lo: int, hi: int):
    """Counts of the prefixes of lo + 1 to hi turns of the entries under heads at the edge."""

    def work(batches):
        for batch in batches:
            found: dict[bytes, list] = {}
            for p in batch["packed"].to_pylist():
                if len(p) <= TURN * lo:
                    continue
                keys = _keys(p, lo, hi)
                if keys[0] not in edge:
                    continue
                for i in range(1, len(keys)):
                    if keys[i] in found:
                        found[keys[i]][-1] += 1
                    else:
                        found[keys[i]] = [keys[i], keys[i - 1], lo + i, int.from_bytes(p[TURN * (lo + i) - 4 : TURN * (lo + i)], "big"), 1]
            yield from _rows([tuple(x) for x in found.values()], _LEVELS)

    return work


def heads_of(kept: DataFrame, limit: int) -> list[tuple[bytes, bytes | None, int, int]]:
    """(key, parent key, depth, bytes of its last text) of every prefix that more than ``limit`` entries have, the root first."""
    heads: list[tuple] = [(ROOT, None, 0, 0)]
    edge, lo, step = {ROOT}, 0, 1
    while edge:
        hi = lo + step
        seen = kept.select("packed").mapInArrow(lean(_levels(edge, lo, hi)), _ddl(_LEVELS))
        big = seen.groupBy("key", "parent", "depth", "size").agg(F.sum("n").alias("n")).filter(F.col("n") > limit)
        new = sorted((r.depth, bytes(r.key), bytes(r.parent), r["size"]) for r in big.collect())
        heads += [(k, p, d, s) for d, k, p, s in new]
        edge, lo, step = {k for d, k, _, _ in new if d == hi}, hi, 2 * step
    return heads


def _place(heads: set[bytes]):
    """Entries to the container under their deepest head; one that ends at a head has none."""

    def work(batches):
        for batch in batches:
            out = []
            for p, n, c, e in zip(*(batch[k].to_pylist() for k in _ENTRY), strict=True):
                depth, turns, h, key, head = 0, len(p) // TURN, hashlib.blake2b(digest_size=16), ROOT, None
                while key in heads and depth < turns:
                    head = key
                    h.update(p[TURN * depth : TURN * (depth + 1)])
                    depth += 1
                    key = h.digest()
                out.append((None, depth, key, p, n, c, e) if key in heads else (key, depth, head, p, n, c, e))
            yield from _rows(out, _PLACED)

    return work


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by (container, packed) to nodes. An open node: [conv_id, depth, n, children, leaves, saved, ends, bytes, closed children]."""
    none = hashlib.sha256().hexdigest()
    stack: list[list] = []
    container, head, base, last = None, None, 0, b""
    out: list[tuple] = []

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            c, d, n, kids, leaves, saved, ends, size, below = stack.pop()
            leaves, saved = leaves or 1, saved + (n - 1) * size
            out.extend((k[0], k[1], c, *k[3:]) for k in below)
            row = (c, d, None, n, kids, leaves, saved, ends, None)
            if stack:
                up = stack[-1]
                up[0], up[2], up[3], up[4], up[5] = min(up[0], c), up[2] + n, up[3] + 1, up[4] + leaves, up[5] + saved
                up[8].append(row)
            else:
                out.append((*row[:-1], head))

    for batch in batches:
        for k, d, h, p, n, c, e in zip(*(batch[x].to_pylist() for x in _PLACED), strict=True):
            turns = len(p) // TURN
            if k != container:
                close(0)
                container, head, base, same = k, h, d, d - 1
            else:
                same, most = base, min(turns, len(last) // TURN)
                while same < most and p[TURN * same : TURN * (same + 1)] == last[TURN * same : TURN * (same + 1)]:
                    same += 1
                close(same - base + 1)
            for i in range(same, turns):
                stack.append([c, i + 1, 0, 0, 0, 0, none, int.from_bytes(p[TURN * (i + 1) - 4 : TURN * (i + 1)], "big"), []])
            top = stack[-1]
            top[0], top[2], top[6] = min(top[0], c), top[2] + n, e
            last = p
        yield from _rows(out, _NODE)
        out.clear()
    close(0)
    yield from _rows(out, _NODE)


def _settled(heads: list[tuple]):
    """Sums of heads: what their containers and the entries that end at them bring, from the deepest heads up."""

    def work(batches):
        none = hashlib.sha256().hexdigest()
        # conv_id, n_convs, children, leaves, saved, ends
        now = {h[0]: [None, 0, 0, 0, 0, none] for h in heads}
        for batch in batches:
            for k, c, n, kids, leaves, saved, ends in zip(*(batch[x].to_pylist() for x in ("head", "conv_id", "n", "kids", "leaves", "saved", "ends")), strict=True):
                now[k] = [c, n, kids, leaves, saved, ends or none]
        above = {h[0]: h[1] for h in heads}
        for k, parent, _, size in sorted(heads, key=lambda h: -h[2]):
            x = now[k]
            x[4] += (x[1] - 1) * size
            if parent is not None:
                up = now[parent]
                up[0], up[1], up[2], up[3], up[4] = x[0] if up[0] is None else min(up[0], x[0]), up[1] + x[1], up[2] + 1, up[3] + x[3], up[4] + x[4]
        rows = [(now[k][0], d, None if above[k] is None else now[above[k]][0], now[k][1], now[k][2], max(now[k][3], 1), now[k][4], now[k][5], k) for k, _, d, _ in heads]
        yield from _rows(rows, _NODE)

    return work


def trie(seqs: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The prefix trie of (conv_id long, packed binary): one row for each distinct prefix, with the columns ``COLUMNS``.

    conv_id: the smallest of the sequences that start with it; depth; parent_conv_id
    (root: null); n_convs; n_children; n_leaves: childless nodes in its subtree;
    saved_tokens: over its subtree, (n_convs - 1) times the bytes of each node's last
    text; ends_sha256: of the ascending ids of the sequences that end there, joined by commas.
    """
    spark = seqs.sparkSession
    small_batches(spark)
    home = run_dir(spark, "trie")
    entries(seqs).write.parquet(f"{home}/entries")
    kept = spark.read.schema(_ddl(_ENTRY)).parquet(f"{home}/entries")
    n, turns = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("packed")), F.lit(0)) / TURN).first()
    if not n:
        return spark.createDataFrame([], _ddl(_NODE)).select(*COLUMNS)
    heads = heads_of(kept, max(container, int(turns) // HEADS))
    kept.mapInArrow(lean(_place({h[0] for h in heads})), _ddl(_PLACED)).write.parquet(f"{home}/placed")
    placed = spark.read.schema(_ddl(_PLACED)).parquet(f"{home}/placed")
    sorted_ = placed.filter("container is not null").repartition("container").sortWithinPartitions("container", "packed")
    sorted_.mapInArrow(lean(_swept), _ddl(_NODE)).write.parquet(f"{home}/nodes")
    nodes = spark.read.schema(_ddl(_NODE)).parquet(f"{home}/nodes")
    tops = nodes.filter("head is not null").select("head", "conv_id", F.col("n_convs").alias("n"), F.lit(1).cast("long").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends"))
    ended = placed.filter("container is null").select("head", "conv_id", "n", *(F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")), "ends")
    sums = tops.unionByName(ended).groupBy("head").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")), F.max("ends").alias("ends"))
    # one row a head, of which there are at most HEADS
    sums.coalesce(1).mapInArrow(_settled(heads), _ddl(_NODE)).write.parquet(f"{home}/heads")
    top = spark.read.schema(_ddl(_NODE)).parquet(f"{home}/heads")
    parents = F.broadcast(top.select("head", F.col("conv_id").alias("_parent")))
    below = nodes.join(parents, "head", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    return below.select(*COLUMNS).unionByName(top.select(*COLUMNS))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations."""
    return trie(rebuilt(conversations))
