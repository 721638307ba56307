"""Shared plumbing: doc-id range shards, shard messages, run folders.

The shard pattern used by the global text operators
---------------------------------------------------
``sharded(docs)`` deals documents into shards by ranges of ``doc_id``; shard
order is document order, and a shard holds a bounded number of bytes.  A shard
writes one message per bucket (distinct hashes only, so a hash that sits in a
third of all rows costs one entry per shard), a bucket answers each shard, and
the shard reads the answers next to its own texts.  The text exchange is the
same in each step, so Spark reuses it.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.sources.shared import fresh_dir as run_dir
from caseloom.sources.shared import shared_dir

#: Parquet bytes that a shard holds on average, unless the session sets ``spark.caseloom.shardBytes``.
#: A shard is one Python group of some thirty times its text in memory at most; each shard writes to
#: each bucket, so large corpora on large executors want larger shards.
SHARD_BYTES = 3 << 20


#: Bytes of rows that Spark hands to Python at once; Spark's own 64 MB times copies and columns fill a small executor.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the Arrow batch size where the session has left it at Spark's default."""
    if spark.conf.get(_BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


#: Plan nodes through which Catalyst's estimate of a scan (its files) stays one of the rows; joins multiply, generators guess.
_PLAIN = frozenset("Project Filter SubqueryAlias Union Sort Repartition RepartitionByExpression RebalancePartitions LogicalRelation DataSourceV2ScanRelation LocalRelation".split())
#: Bytes of text that Parquet writes as one, about.
TEXT_TO_FILE = 2


def _is_plain(node) -> bool:
    kids = node.children()
    return node.getClass().getSimpleName() in _PLAIN and all(_is_plain(kids.apply(i)) for i in range(kids.size()))


def plan_bytes(df: DataFrame) -> int:
    """Bytes of files that the rows would fill, about: of a plain scan Catalyst's estimate, of any other plan the measured texts."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if _is_plain(plan):
        return int(str(plan.stats().sizeInBytes()))
    text = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16) if "text" in df.columns else F.count(F.lit(1)) * 512
    return int(df.agg(text).first()[0] or 0) // TEXT_TO_FILE


def fresh(name: str, columns: list[str]) -> str:
    """``name``, or one like it that is none of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def hashable(docs: DataFrame, names: Iterable[str]) -> list[Column]:
    """The columns of such names as Spark's hashes take them: maps, which they don't, as their JSON."""
    return [F.to_json(F.struct(_named(c))) if _has_map(docs.schema[c].dataType) else _named(c) for c in names]


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shard_count(docs: DataFrame) -> int:
    spark = docs.sparkSession
    shard_bytes = int(spark.conf.get("spark.caseloom.shardBytes", str(SHARD_BYTES)))
    return max(shuffle_partitions(spark), math.ceil(plan_bytes(docs) / shard_bytes))


def bucket_count(spark: SparkSession, n_shards: int) -> int:
    """Buckets hold what several shards send; each shard writes to each bucket, so there are fewer of them."""
    return max(shuffle_partitions(spark), n_shards // 4)


def shard_bounds(docs: DataFrame) -> list[int]:
    """Ids that part the documents into ranges of about equal counts."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(["text"] if "text" in docs.columns else []))
    n = shard_count(base)
    cuts = base.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)
    return sorted({int(x) for x in cuts})


def shard_of(bounds: list[int]):
    """The range that ``doc_id`` lies in, by binary search over the bounds; null is in the first."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    edges = F.lit(bounds).cast("array<bigint>")
    found = F.aggregate(
        F.lit(steps).cast("array<int>"),
        F.lit(0),
        lambda at, step: F.when(F.get(edges, at + step - 1) < F.col("doc_id"), at + step).otherwise(at),
    )
    return found.cast("int")


def sharded(docs: DataFrame, bounds: list[int] | None = None) -> tuple[DataFrame, int]:
    """(shard int, doc_id long, text string) and the number of shards.

    Shards are ranges of ``doc_id``: every id of shard i is smaller than every
    id of shard i + 1.  Null ids come first.  Rows with one id share a shard.
    """
    small_batches(docs.sparkSession)
    bounds = shard_bounds(docs) if bounds is None else bounds
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return base.select(shard_of(bounds).alias("shard"), "doc_id", "text"), len(bounds) + 1


#: Bits of the filter that rows pass before they meet ids: 262,144 words at most, however many ids there are.
FILTER_BITS = 24


def _bit(column: Column) -> Column:
    return F.pmod(F.xxhash64(column.cast("long")), F.lit(1 << FILTER_BITS))


def id_filter(ids: DataFrame, path: str) -> DataFrame:
    """(word, bits): a bitmap of the hashes of column ``id``, written to a path."""
    at = ids.select(_bit(F.col("id")).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    words.write.parquet(path)
    return ids.sparkSession.read.schema("word long, bits long").parquet(path)


def maybe_in(rows: DataFrame, column: str, words: DataFrame, others: bool = False) -> DataFrame:
    """Rows whose id may be among the filter's, a few more than are; with ``others`` those whose id surely isn't. Nothing is shuffled."""
    word, bits = fresh("_word", rows.columns), fresh("_bits", rows.columns)
    at = _bit(_named(column))
    told = rows.join(F.broadcast(words.toDF(word, bits)), F.shiftright(at, 6) == F.col(word), "left" if others else "inner")
    hit = F.coalesce(F.getbit(F.col(bits), (at % 64).cast("int")) == 1, F.lit(False))
    return told.filter(~hit if others else hit).drop(word, bits)


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column, and where each row starts and ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def in_order(ids: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by (doc_id, text)."""
    order = np.argsort(ids, kind="stable")
    tied = (ids[order][1:] == ids[order][:-1]).any()
    if not tied and (order[1:] > order[:-1]).all():
        return ids, data, off
    raw = data.tobytes()
    row = lambda i: raw[off[i] : off[i + 1]]
    if tied:
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], row(i))))
    size = np.diff(off)[order]
    return ids[order], np.frombuffer(b"".join([row(i) for i in order.tolist()]), np.uint8), np.concatenate(([0], np.cumsum(size)))


def spans_of(off: np.ndarray, limit: int):
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def int_column(table, name: str, null: int = -(2**63)) -> np.ndarray:
    c = table[name]
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)
    return c.fill_null(null).to_numpy(zero_copy_only=False)


#: What a null id is called inside; it sorts before all others.
NULL_ID = -(2**63)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def _give_back() -> None:
    """Hands freed memory to the system: Spark keeps workers, and theirs counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(work):
    """A function over batches or groups that gives its freed memory back when it is done."""
    if inspect.isgeneratorfunction(work):

        @functools.wraps(work)
        def run(batches):
            pa.set_memory_pool(pa.system_memory_pool())
            try:
                for out in work(batches):
                    yield out
                    _give_back()
            finally:
                _give_back()

    elif len(inspect.signature(work).parameters) == 1:

        @functools.wraps(work)
        def run(table):
            pa.set_memory_pool(pa.system_memory_pool())
            try:
                return work(table)
            finally:
                _give_back()

    else:

        @functools.wraps(work)
        def run(key, left, right):
            pa.set_memory_pool(pa.system_memory_pool())
            try:
                return work(key, left, right)
            finally:
                _give_back()

    return run
