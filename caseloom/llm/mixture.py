"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and
share ``SHARE`` times all words; a target stops at twice its source's words and
the excess is shared again by weight.  Equal blocks of ``BLOCK`` words are
allotted to sources by the highest quotients target / (2 seats + 1), then each
source's blocks to its shards in the same way by their words.  In a shard the
documents of a source stand in seeded order, and the quota is met by whole
rounds and one seeded stretch of blocks, so a document is taken at most twice.

Shards are dealt by a hash of the id and text, so a source with a third of all
rows is ordered in many small groups, and so are rows without id.  Sources are
planned in the driver where their table is measured to be under
``BROADCAST_BYTES``; beyond it they stay a table, however many they are, and the
driver sees only sums over it (of the targets that stop, and of the seats that a
few dozen divisors would give).

Rows: null and blank texts have size 0 and are never taken; rows with one id
count one by one, and those of one id and size stand in the order of a hash of
their columns; an empty table gives no rows; other columns ride along if asked
for.  The same rows give the same result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import bytes_of, hashable, lean, shared_dir, small_batches
from caseloom.llm.hashing import words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 16
ROWS_A_SHARD = 4000
SEED = 42
#: Shards that share blocks in one group.
FAN = 1 << 16
#: Bytes of the sources' table up to which it comes to the driver and is broadcast to the rows.
BROADCAST_BYTES = 4 << 20
#: Divisors that one pass over the sources tries.
DIVISORS = 40


def shares(sizes: list[int], weights: list[float], share: float = SHARE, most: int = MOST) -> list[float]:
    """share of all, by weight; a target stops at ``most`` times its size and the excess is shared again."""
    out = [0.0] * len(sizes)
    left, active = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


def sainte_lague(votes, seats: int, caps) -> np.ndarray:
    """Seats by the highest quotients votes / (2 s + 1); none gets more than its cap; ties go to the first."""
    v, c = np.asarray(votes, float), np.asarray(caps, np.int64)
    c = np.where(v > 0, c, 0)
    seats = int(min(seats, c.sum()))
    at = lambda d: np.minimum(np.floor(v / d + 0.5), c).astype(np.int64)
    lo, hi = 1e-12, max(1.0, float(v.max(initial=0)) * 4)
    for _ in range(200):  # the divisor that gives at most so many
        mid = math.sqrt(lo * hi)
        if at(mid).sum() > seats:
            lo = mid
        else:
            hi = mid
    got = at(hi)
    heap = [(-v[i] / (2 * got[i] + 1), i) for i in range(len(v)) if got[i] < c[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < c[i]:
            heapq.heappush(heap, (-v[i] / (2 * got[i] + 1), i))
    return got


def word_count(text="text"):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """The sources with ``sid``, their place in code point order, null last; no task holds more than its range of them."""
    parts = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()).checkpoint()
    before, offset = 0, []
    for part, n in sorted((r[0], r[1]) for r in parts.groupBy("part").count().collect()):
        offset.append((part, before))
        before += n
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    base = sources.sparkSession.createDataFrame(offset, "part int, base long")
    return parts.withColumn("place", place).join(F.broadcast(base), "part").select("source", "n", (F.col("base") + F.col("place")).alias("sid"))


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, n, sid): share of all words by weight; one that stops at ``most`` times its words leaves the excess to the others."""
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS)).cast("int"))
    rows = sources.withColumn("w", F.when(F.col("n") > 0, weight).otherwise(0.0))
    level = 0.0  # words for each unit of weight; rises until no further target stops
    while True:
        stops = F.col("w") * level > most * F.col("n")
        left = F.coalesce(F.sum("n"), F.lit(0)) * share - F.coalesce(F.sum(F.when(stops, most * F.col("n"))), F.lit(0))
        got = rows.agg(left.cast("double").alias("left"), F.coalesce(F.sum(F.when(stops, 0.0).otherwise(F.col("w"))), F.lit(0.0)).alias("w")).first()
        if got.w <= 0 or (nxt := got.left / got.w) <= level:
            break
        level = nxt
    return rows.withColumn("target", F.least(F.col("w") * level, (most * F.col("n")).cast("double"))).drop("w")


def allotted(sources: DataFrame) -> DataFrame:
    """Adds ``blocks``: seats by the highest quotients target / (2 s + 1), at most what twice the source holds; ties go to the first source."""
    cap = F.ceil(MOST * F.col("n") / BLOCK).cast("long")
    rows = sources.withColumn("cap", F.when(F.col("target") > 0, cap).otherwise(0))
    at = lambda d: F.least(F.floor(F.col("target") / d + 0.5), F.col("cap")).cast("long")
    got = rows.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("all"), F.coalesce(F.max("target"), F.lit(0.0)).alias("top"), F.coalesce(F.sum("cap"), F.lit(0)).alias("room"), F.count_if(F.col("cap") > 0).alias("n")).first()
    seats = min(round(got["all"] / BLOCK), got.room)

    def given(tried: list[float]) -> list[int]:
        """Seats that each divisor gives."""
        one = rows.select("target", "cap", F.posexplode(F.array(*[F.lit(d) for d in tried])).alias("i", "d"))
        return [r.s for r in one.groupBy("i").agg(F.sum(at(F.col("d"))).alias("s")).orderBy("i").collect()]

    # a source has half a seat more or less than target / divisor, or its cap: the divisor that gives at most so many lies between
    lo, hi = got["all"] / (seats + got.n + 1), max(1.0, 4 * got["all"])
    if seats > got.n:
        hi = min(hi, got["all"] / (seats - got.n))
    while got.top * (1 / lo - 1 / hi) >= 1 if lo else False:  # until no source gets two seats more between them
        step = (hi / lo) ** (1 / (DIVISORS + 1))
        tried = [lo * step ** (i + 1) for i in range(DIVISORS)]
        if not lo < tried[0] < tried[-1] < hi:
            break
        sums, ends = given(tried), [lo, *tried, hi]
        k = next((i for i in range(DIVISORS) if sums[i] <= seats), DIVISORS)
        lo, hi = ends[k], ends[k + 1]
    rows = rows.withColumn("blocks", at(hi))
    rest = seats - int(rows.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0])
    if rest > 0:
        more = rows.filter("blocks < cap").select("sid", (F.col("target") / (2 * F.col("blocks") + 1)).alias("q")).orderBy(F.desc("q"), "sid").limit(rest).select("sid", F.lit(1).alias("more"))
        rows = rows.join(more, "sid", "left").withColumn("blocks", F.col("blocks") + F.coalesce("more", F.lit(0))).drop("more")
    return rows.drop("cap")


def planned_here(sources: DataFrame) -> DataFrame:
    """What ``ranked``, ``targets`` and ``allotted`` give, for a table of sources of measured, bounded size: in the driver, without their passes."""
    found = sorted(((r.source is None, (r.source or "").encode(), r.source, int(r.n)) for r in sources.collect()), key=lambda r: r[:2])
    sizes = [r[3] for r in found]
    goal = shares(sizes, [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(found))])
    blocks = sainte_lague(goal, round(sum(goal) / BLOCK), [-(-MOST * n // BLOCK) for n in sizes])
    rows = [(i, r[2], r[3], goal[i], int(blocks[i])) for i, r in enumerate(found)]
    return sources.sparkSession.createDataFrame(rows, "sid long, source string, source_size long, target double, blocks long")


def _quotas(table: pa.Table) -> pa.Table:
    """A source's blocks to its shards: a row for each shard, no documents."""
    table = table.sort_by("shard").select(["sid", "shard", "avail", "blocks"])
    avail = table["avail"].to_numpy()
    got = sainte_lague(avail, table["blocks"][0].as_py(), -(-MOST * avail // BLOCK))
    return table.drop_columns("blocks").append_column("quota", pa.array(got, pa.int64()))


def quotas(avail: DataFrame, n_shards: int, fan: int = FAN) -> DataFrame:
    """(sid, shard, avail, quota) of (sid, shard, avail, blocks): a source's blocks to its shards by the highest quotients.

    Where a source may have more than ``fan`` shards, runs of so many share its
    blocks first and then each run's shards its own, so a group has ``fan`` rows at most.
    """
    ddl = "sid long, shard int, avail long, quota long"
    if n_shards <= fan:
        return avail.groupBy("sid").applyInArrow(_quotas, ddl)
    run = F.floor(F.col("shard") / fan).cast("int")
    sums = avail.groupBy("sid", run.alias("shard")).agg(F.sum("avail").alias("avail"), F.first("blocks").alias("blocks"))
    above = quotas(sums, -(-n_shards // fan), fan).select("sid", F.col("shard").alias("_run"), F.col("quota").alias("blocks"))
    return avail.drop("blocks").withColumn("_run", run).join(above, ["sid", "_run"]).groupBy("sid", "_run").applyInArrow(lambda t: _quotas(t.drop_columns("_run")), ddl)


def mixture(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row, and how it is taken: whole rounds, and words [lo, hi) and [0, wrap)."""
    spark = docs.sparkSession
    shared_dir(spark)
    tie = F.xxhash64("text", *hashable(docs, carry))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), tie.alias("tie"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    if not carry:
        rows = rows.checkpoint()  # texts are counted once
    sources = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).checkpoint()
    all_ = sources.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.octet_length("source") + 64), F.lit(0)).alias("bytes")).first()
    n_shards = max(1, math.ceil(all_.rows / ROWS_A_SHARD))
    if few := all_.bytes <= BROADCAST_BYTES:
        info = planned_here(sources)
    else:
        info = allotted(targets(ranked(sources.select("source", "n"))).checkpoint()).withColumnRenamed("n", "source_size").checkpoint()
    hint = F.broadcast if few else lambda df: df
    named = rows.withColumnRenamed("source", "_source").join(hint(info.select("sid", "source", "source_size", "target")), F.col("_source").eqNullSafe(F.col("source"))).drop("_source", "source")
    dealt = named.withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "tie"), F.lit(n_shards)).cast("int"))
    avail = dealt.groupBy("sid", "shard").agg(F.sum("size").alias("avail")).join(hint(info.select("sid", "blocks")), "sid")
    quota = quotas(avail, n_shards)
    order = Window.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(SEED + 1), "doc_id"), "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0))).join(quota, ["sid", "shard"])
    words_due = F.least(F.col("quota") * BLOCK, F.col("avail") * MOST)
    whole = F.when(F.col("avail") > 0, F.floor(words_due / F.greatest("avail", F.lit(1)))).otherwise(0).cast("long")
    n_blocks = F.greatest(F.ceil(F.col("avail") / BLOCK), F.lit(1)).cast("long")
    placed = placed.withColumn("whole", whole).withColumn("rest", words_due - F.col("whole") * F.col("avail"))
    placed = placed.withColumn("off", F.pmod(F.xxhash64(F.lit(SEED + 2), "sid", "shard"), n_blocks) * BLOCK)
    clip = lambda x: F.greatest(F.lit(0), F.least(F.col("size"), x)).cast("long")
    placed = placed.withColumns(
        {
            "lo": clip(F.col("off") - F.col("at")),
            "hi": clip(F.least(F.col("off") + F.col("rest"), F.col("avail")) - F.col("at")),
            "wrap": clip(F.col("off") + F.col("rest") - F.col("avail") - F.col("at")),
        }
    )
    taken = F.col("whole") * F.col("size") + F.greatest(F.col("hi") - F.col("lo"), F.lit(0)) + F.col("wrap")
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "whole", "lo", "hi", "wrap", *[F.col(f"_c_{c}").alias(f"_c_{c}") for c in carry])


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with their columns: once for each whole round, and the words of a stretch as one more."""
    small_batches(docs.sparkSession)
    names = docs.columns
    got = mixture(docs, tuple(names)).select("taken", "whole", "lo", "hi", "wrap", *[F.col(f"_c_{c}").alias(c) for c in names]).filter("taken > 0").drop("taken")
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plan = [b.column(i).to_numpy() for i in range(4)]
            cols = b.columns[4:]
            base = pa.RecordBatch.from_arrays(cols, names)
            for k in range(int(plan[0].max(initial=0))):
                yield base.filter(pa.array(plan[0] > k))
            pick = np.flatnonzero((plan[2] > plan[1]) | (plan[3] > 0))
            if not len(pick):
                continue
            part = base.take(pa.array(pick))
            data, off = bytes_of(part.column(at))
            _, s, e, w = words(data, off, lower=False)
            raw, texts = data.tobytes(), []
            for r, i in enumerate(pick.tolist()):
                lo, hi, wrap = (int(plan[k][i]) for k in (1, 2, 3))
                cuts = [(0, wrap), (lo, hi)]
                texts.append("\n".join(raw[s[w[r] + a] : e[w[r] + z - 1]].decode() for a, z in cuts if z > a))
            new = list(part.columns)
            new[at] = pa.array(texts, new[at].type)
            if count is not None:
                new[count] = pa.array([len(t) for t in texts], new[count].type)
            yield pa.RecordBatch.from_arrays(new, names)

    return got.mapInArrow(lean(run), T.StructType(docs.schema.fields))
