"""Bounded, reproducible samples of labelled documents for the classifiers."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOWEST, _SPAN = -(2**63), 2**64
#: Labels whose counts come to the driver.
MOST_LABELS = 500_000
#: Ids of all labels that come to the driver; where labels are many, each has fewer.
MOST_IDS = 1_000_000


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def agreed(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, label) of documents that exist: equal labels of one id count once, an id with different ones teaches nothing.

    Only ids are shuffled.
    """
    one = labels.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).filter("label = _other").drop("_other")
    return one.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")


def sample_ids(known: DataFrame, per_class: int) -> tuple[list[tuple], dict]:
    """At most ``per_class`` ids of each label, smallest hash first, and the label counts over all rows of known (doc_id, label).

    Before any id comes to the driver, each label keeps the hashes under a bound that some twice ``per_class`` of its ids pass.
    """
    spark = known.sparkSession
    counts = {r[0]: r[1] for r in known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels can't be told apart")
    if not counts:
        return [], counts
    kind = dict(known.dtypes)["label"]
    per_class = max(1, min(per_class, MOST_IDS // len(counts)))
    bounds = [(y, min(2**63 - 1, _LOWEST + int(_SPAN * min(1.0, 2 * (per_class + 50) / n)))) for y, n in counts.items()]
    some = known.join(F.broadcast(spark.createDataFrame(bounds, f"label {kind}, bound long")), "label")
    some = some.select("doc_id", "label", F.xxhash64("doc_id").alias("h"), "bound").filter("h <= bound").drop("bound").distinct()
    by: dict[object, list] = defaultdict(list)
    for r in some.collect():
        by[r.label].append((r.h, r.doc_id))
    return [(d, y) for y in counts for _, d in sorted(by[y])[:per_class]], counts


def sample_texts(docs: DataFrame, picked: list[tuple], max_bytes: int) -> list[tuple[int, str, object]]:
    """(doc_id, text, label) of the picked ids, in a fixed order: whole texts, each that still fits into its label's share of ``max_bytes``.

    If docs has a column ``label``, only its rows with the picked label count.
    """
    if not picked:
        return []
    spark = docs.sparkSession
    kind = "string" if isinstance(picked[0][1], str) else "int"
    ids = spark.createDataFrame(picked, f"doc_id long, label {kind}")
    keys = ["doc_id", "label"] if "label" in docs.columns else ["doc_id"]
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keys[1:]).join(F.broadcast(ids), keys)
    order = got.select("doc_id", "text", "label", F.xxhash64(F.lit(7), "doc_id").alias("h"), F.octet_length("text").alias("n"))
    # the bound on bytes is applied to lengths first, so that no more than max_bytes of text comes to the driver
    share = max_bytes // len({y for _, y in picked})
    sizes = sorted(Counter((r.h, r.doc_id, r.n, r.label) for r in order.select("h", "doc_id", "n", "label").distinct().collect()))
    total: Counter = Counter()
    fits = []
    for _, d, n, y in sizes:
        if total[y] + n <= share:  # one that doesn't fit is passed over
            total[y] += n
            fits.append((d, n, y))
    if not fits:
        return []
    fit = spark.createDataFrame(fits, f"doc_id long, n int, label {kind}")
    # rows that share id, label and length count once
    kept = order.join(F.broadcast(fit), ["doc_id", "n", "label"], "left_semi").groupBy("h", "doc_id", "n", "label").agg(F.min("text").alias("text"))
    rows = sorted(((r.h, r.doc_id, r.text, r.label) for r in kept.collect()), key=lambda r: (r[:3], str(r[3])))
    return [(d, t, y) for _, d, t, y in rows]


def learnt(data: list, counts: dict, what: str) -> list:
    """The sample; labelled rows of which not one can be learnt from are an error, not a constant model."""
    if counts and not data:
        raise ValueError(f"{sum(counts.values())} rows with {what}, but none of the picked texts fits the bound on bytes")
    return data
