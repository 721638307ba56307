"""Connected components of an edge table, on all executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import run_dir


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reached) of the edges a - b: labels sink and jump until nothing moves."""
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # hook both ends' roots to the smaller label
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what a - b connect: at most one for each node."""
    if not len(a):
        return a, b
    n, r = roots(a, b)
    keep = n != r
    return n[keep], r[keep]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = forest(np.concatenate((a, batch.column(0).to_numpy())), np.concatenate((b, batch.column(1).to_numpy())))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def connected_components(edges: DataFrame, u: str, v: str, contract: bool = True) -> DataFrame:
    """(id, component): the smallest id that each id on an edge reaches.

    Partitions first shrink to forests (``contract``: not where they come as such); then large-star and small-star rounds
    hang every node on its component's smallest one.  Each round is a written
    table, so a lost executor costs one round, and no group is held in memory.
    """
    spark = edges.sparkSession
    home = run_dir(spark, "components")
    now = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u is not null and v is not null and u <> v")
    if contract:
        now = now.mapInArrow(_contract, "u long, v long")
    before = None
    for i in range(200):
        now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().write.parquet(f"{home}/{i}")
        now = spark.read.schema("u long, v long").parquet(f"{home}/{i}")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = small.filter("u <> v")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
