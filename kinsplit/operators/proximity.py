"""Distances of zipped rows, proximity edges, and nearest neighbours, exactly.

Items are a DataFrame with a unique long ``id`` and an ``item`` column of the kernel's type. Null ids or items are
refused: they have no distance.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from kinsplit.functions.kernels import Kernel, make_kernel
from kinsplit.operators.edges import EdgeStore
from kinsplit.plans import blocks
from kinsplit.plans.blocks import unpacked
from kinsplit.plans.storage import materialize

CHUNK, CELLS = 500, 2_000_000  # rows of a block, and distances, that are held at once


def _items(df: DataFrame, id_col: str, item_col: str) -> DataFrame:
    checked = lambda c: F.when(F.col(f"`{c}`").isNull(), F.raise_error(F.lit(f"{c} must not be null"))).otherwise(F.col(f"`{c}`"))
    return df.select(checked(id_col).cast("long").alias("id"), checked(item_col).alias("item"))


def zip_kernel(variant, data1: DataFrame, data2: DataFrame, *args, id_col: str = "id", item_col: str = "item", n_threads: int = 0, progress: bool = True, **kwargs) -> DataFrame:
    """(id, distance) of the rows of both inputs with the same id; ValueError if the ids are not the same."""
    kernel = make_kernel(variant, *args, **kwargs)
    a, b = _items(data1, id_col, item_col), _items(data2, id_col, item_col).withColumnRenamed("item", "other")
    if not (a.count() == b.count() == a.join(b, "id").count()):
        raise ValueError("both inputs must have the same number of items, under the same ids")
    on = a.join(b, "id")
    if kernel.column:
        return on.select("id", kernel.column(F.col("item"), F.col("other")).alias("distance"))
    return on.select("id", _distance_of_pairs(kernel)(F.col("item"), F.col("other")).alias("distance"))


def _distance_of_pairs(kernel: Kernel):
    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(kernel.zipped(a.tolist(), b.tolist()), dtype="float64")

    return f


def exact_edges(variant, data: DataFrame, proximity_threshold: float = 0.5, *args, id_col: str = "id", item_col: str = "item", n_threads: int = 0, progress: bool = True, **kwargs) -> EdgeStore:
    """All pairs src < dst with a distance strictly under the threshold, with the distance as weight.

    Items meet in pairs of blocks that their sizes allow; real and bit fingerprints rule out most pairs there by products.
    """
    kernel = make_kernel(variant, *args, **kwargs)
    items = _items(data, id_col, item_col)
    return EdgeStore(items.select("id"), edges_among(kernel, items, proximity_threshold))


def edges_among(kernel: Kernel, items: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, weight) of :func:`exact_edges`; where ``items`` (id, item) has a column ``fresh``, only pairs with one that is."""
    some = "fresh" in items.columns
    placed, spans = blocks.by_size(items, kernel.size(F.col("item")), kernel.rows_per_block, kernel.edge_blocks or kernel.most_blocks, most_size=kernel.most_size)
    dealt = blocks.block_pairs(blocks.packed(placed, len(spans)), spans, lambda small, large: 1 - kernel.bound(small, large) < threshold)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, same = ([], []), key[0].as_py() == key[1].as_py()
        for batch in batches:
            for side, data in zip(batch.column("side").to_pylist(), batch.column("data")):
                sides[side].append(data)
        a, b = (unpacked(s) for s in ((sides[1], sides[1]) if same else sides))
        if a is None or b is None:
            return
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        fa, fb = (x["fresh"].to_numpy() if some else None for x in (a, b))
        queries = kernel.load_column(b["item"])
        step = kernel.chunk or max(1, min(CHUNK, CELLS // len(ib)))
        for s in range(0, len(ia), step):
            i, j, d = kernel.near(kernel.load_column(a["item"].slice(s, step)), queries, threshold)
            kept = ia[s + i] < ib[j] if same else np.ones(len(i), bool)
            if some:
                kept &= fa[s + i] | fb[j]
            x, y = ia[s + i[kept]], ib[j[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d[kept].astype(float))], ["src", "dst", "weight"])

    return dealt.groupBy("bi", "bj").applyInArrow(run, "src long, dst long, weight double")


def exact_edges_total(n: int) -> int:
    """Pairs that exact_edges decides."""
    return n * (n - 1) // 2


def exact_nearest_neighbors(variant, queries: DataFrame, references: DataFrame, k: int, *args, id_col: str = "id", item_col: str = "item", threads: int = 0, progress: bool = True, **kwargs) -> DataFrame:
    """(query_id, rank, ref_id, distance): the k nearest references of each query, ties by the lower reference id.

    Queries and references lie in blocks by size. First each query block meets the reference blocks next to it in size
    that hold k rows; what it finds bounds the k-th distance of its worst query, and of the other blocks only those
    whose sizes allow a distance within that bound are met. Each meeting keeps k a query, and a window over those finds
    the k of all. A query that is also a reference finds itself.
    """
    kernel = make_kernel(variant, *args, **kwargs)
    q, r = _items(queries, id_col, item_col), _items(references, id_col, item_col)
    q, q_spans = blocks.by_size(q, kernel.size(F.col("item")), kernel.rows_per_block, kernel.most_blocks, most_size=kernel.most_size)
    # fewer, larger reference blocks, as each meeting keeps k a query
    r, r_spans = blocks.by_size(r, kernel.size(F.col("item")), kernel.rows_per_block, kernel.most_blocks and -(-kernel.most_blocks // 3), 3 * blocks.MOST_ROWS, kernel.most_size)
    r = materialize(r, "blocks")
    count = {row["block"]: row["n"] for row in r.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    q, r = blocks.packed(q, len(q_spans)), blocks.packed(r, len(r_spans))

    def least_distance(i: int, j: int) -> float:
        """What the kernel's bound leaves possible between a query block and a reference block."""
        (a, b), (c, d) = q_spans[i], r_spans[j]
        small, large = min(b, d), max(a, c)
        return 1 - kernel.bound(small, large) if small < large else 0.0

    def run(key: tuple, qs: pa.Table, rs: pa.Table) -> pa.Table:
        a, b = unpacked(qs["data"]), unpacked(rs["data"])
        found = []
        if a is not None and b is not None:
            b = b.sort_by("id")
            refs, ids, rows = kernel.load_column(b["item"]), b["id"].to_numpy(), a["id"].to_numpy()
            step = max(1, min(kernel.chunk or CHUNK, (8 if kernel.chunk else 1) * CELLS // len(ids)))
            for s in range(0, len(rows), step):
                top, d = kernel.nearest(kernel.load_column(a["item"].slice(s, step)), refs, k)  # the query is the first argument
                found.append((np.repeat(rows[s : s + step], top.shape[1]), ids[top].ravel(), d.ravel()))
        query, ref, distance = (np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in range(3))
        return pa.table({"query_id": query.astype(np.int64), "ref_id": ref.astype(np.int64), "distance": distance.astype(float), "qb": np.full(len(query), key[0].as_py(), np.int32)})

    def meet(ranges: list[tuple[int, int, int]]) -> DataFrame:
        """Query blocks with ranges (first to last) of reference blocks; each range becomes its pairs on the executors."""
        table = q.sparkSession.createDataFrame(ranges or [(-1, 0, 0)], "qb int, first int, last int")
        qd = q.join(F.broadcast(table), q["block"] == F.col("qb")).select("data", "qb", F.explode(F.sequence("first", "last")).alias("rb"))
        met = table.select(F.col("qb").alias("r_qb"), F.explode(F.sequence("first", "last")).alias("r_rb"))
        rd = r.join(met, r["block"] == F.col("r_rb")).select("data", "r_qb", "r_rb")
        return qd.groupBy("qb", "rb").cogroup(rd.groupBy("r_qb", "r_rb")).applyInArrow(run, "query_id long, ref_id long, distance double, qb int")

    def within(i: int, far: float, start: int, step: int) -> int:
        """How many blocks from ``start`` on, one way, can hold a distance up to ``far``; the bound only grows that way."""
        lo, hi = 0, len(r_spans) - start if step > 0 else start + 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if least_distance(i, start + step * mid) <= far + 1e-9 else (lo, mid)
        return lo

    near_ranges, ends = [], bisect_points(r_spans, q_spans)
    for i, at in enumerate(ends):
        first = last = at
        rows = count.get(at, 0)
        while rows < k and (first > 0 or last < len(r_spans) - 1):
            if last == len(r_spans) - 1 or (first > 0 and least_distance(i, first - 1) <= least_distance(i, last + 1)):
                first -= 1
                rows += count.get(first, 0)
            else:
                last += 1
                rows += count.get(last, 0)
        near_ranges.append((i, first, last))
    near = materialize(meet(near_ranges), "near")
    nth = near.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("distance"))).where(F.col("n") == k)
    worst = {x["qb"]: x["d"] for x in nth.groupBy("qb").agg(F.max("distance").alias("d")).collect()}
    more = []
    for i, first, last in near_ranges:
        far = worst.get(i, math.inf)
        left, right = within(i, far, first - 1, -1), within(i, far, last + 1, 1)
        more += [(i, first - left, first - 1)] * (left > 0) + [(i, last + 1, last + right)] * (right > 0)
    if more:
        near = near.unionByName(meet(more))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "ref_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "distance")


def bisect_points(r_spans: list[tuple[float, float]], q_spans: list[tuple[float, float]]) -> list[int]:
    """For each query span the reference span nearest to it in size, both lists being in order of size."""
    middles = [lo + hi for lo, hi in r_spans]
    at = [bisect_left(middles, lo + hi) for lo, hi in q_spans]
    return [max(0, min(len(middles) - 1, i - (i == len(middles) or (i > 0 and lo + hi - middles[i - 1] < middles[i] - lo - hi)))) for i, (lo, hi) in zip(at, q_spans)]


def exact_nearest_neighbors_total(n_queries: int, n_references: int) -> int:
    """Pairs that exact_nearest_neighbors decides."""
    return n_queries * n_references
