"""Connected components by alternating large-star and small-star joins (O(log^2 n) rounds, nothing collected)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinsplit.plans.storage import materialize, release

AT_ONCE = 1_000_000  # edges that a task joins up together


def local_forests(edges: DataFrame, src: str = "src", dst: str = "dst", at_once: int = AT_ONCE) -> DataFrame:
    """(src, dst) with the components of ``edges``: each task joins up the edges that it has, by about ``at_once``, and
    gives one edge a node but the smallest for each part. Never more rows than edges; of a dense graph far fewer, as many
    as a task has nodes. The ids are longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= at_once:
                held = [_stars(*map(np.concatenate, zip(*held)))]
                n = len(held[0][0])
                if 2 * n > at_once:  # too many to meet the next edges
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["src", "dst"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(*map(np.concatenate, zip(*held)))], ["src", "dst"])

    ends = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
    return ends.where("src <> dst").mapInArrow(run, "src long, dst long")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges with the smallest of their part, without those themselves. Roots hook to smaller ones they meet."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = root[i], root[j]
        apart = p != q
        if not apart.any():
            break
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := root[root], root):
            root = up
    own = root == np.arange(len(nodes))
    return nodes[~own], nodes[root[~own]]


def star_forest(edges: DataFrame, src: str = "src", dst: str = "dst", rows: int | None = None) -> DataFrame:
    """(node, root) for every node of at least one edge; root is the smallest node of its component.

    Each round is two aggregations and two joins over the edge set, which shrinks towards one edge a node. Partial
    aggregation keeps hubs from shuffling whole; adaptive skew splitting deals out the joins on them. ``rows``: a
    bound of the number of edges, where one is known.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    e = e.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "cc", rows)
    seen = _signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "cc", seen[0])
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        nxt = materialize(small.where("u != v").distinct(), "cc", 2 * seen[0])
        release(large, e)
        now, e = _signature(nxt), nxt
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(e: DataFrame) -> tuple[int, int]:
    """Rows and a hash of a set of edges; exclusive or, as a sum of hashes overflows at some ten million edges."""
    r = e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return int(r[0]), int(r[1])
