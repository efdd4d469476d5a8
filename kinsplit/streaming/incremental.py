"""Proximity edges of a growing collection: a micro-batch against what is there, for ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinsplit.functions.kernels import make_kernel
from kinsplit.operators.proximity import _items, edges_among


def new_edges(variant, known: DataFrame, batch: DataFrame, proximity_threshold: float = 0.5, **options) -> DataFrame:
    """Edges (src, dst, weight) with at least one end in ``batch``; both inputs are (id, item) with ids of their own.

    The pruning plans see both collections at once, so pairs that sizes or rare bits rule out are never evaluated, and a pair of
    known items is left out where it is found.
    """
    args = {c: options.pop(c, c.removesuffix("_col")) for c in ("id_col", "item_col")}
    for c in ("n_threads", "progress"):
        options.pop(c, None)
    items = lambda df, fresh: _items(df, **args).withColumn("fresh", F.lit(fresh))
    return edges_among(make_kernel(variant, **options), items(known, False).unionByName(items(batch, True)), proximity_threshold)
