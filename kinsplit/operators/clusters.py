"""Clusters of a graph, and splits along them. Assignments are (id, cluster), clusters numbered from 0."""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame, functions as F

from kinsplit.operators.components import local_forests, star_forest
from kinsplit.operators.graph import CsrGraph
from kinsplit.plans.ranking import numbered
from kinsplit.plans.storage import materialize


def relabel(rooted: DataFrame) -> DataFrame:
    """(id, root) to (id, cluster): roots numbered in order of their clusters' smallest ids."""
    number = numbered(rooted.groupBy("root").agg(F.min("id").alias("first")), "cluster", "first").select("root", "cluster")
    return rooted.join(number, "root").select("id", "cluster")


def find_components(graph: CsrGraph) -> DataFrame:
    """Connected components, numbered by their smallest ids. The edges are read once and nowhere written or shuffled whole."""
    roots = materialize(star_forest(local_forests(graph.store.edges)), "roots")
    on = graph.vertices.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))
    return relabel(on)


def largest_cluster(clusters: DataFrame) -> tuple[int, int]:
    """(cluster, size) of the largest cluster, ties by the lower number; (0, 0) without rows."""
    r = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster").first()
    return (r["cluster"], r["n"]) if r else (0, 0)


def _single(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def test_count(test_ratio: float, clusters: int) -> int:
    """Clusters of the test side: the ceiling of a single-precision product."""
    return math.ceil(_single(_single(test_ratio) * _single(clusters)))


def partition(clusters: DataFrame, graph: CsrGraph, test_ratio: float = 0.2, seed: int | None = None, post_filtering: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, test) ids: whole clusters, ceil(test_ratio * number of clusters) of them for test.

    Clusters are ranked by md5 of "seed:cluster". With post_filtering, train vertices next to a test vertex are left
    out of both. ValueError without clusters, for a ratio outside (0, 1), and for ids that differ from the graph's.
    """
    if not 0 < test_ratio < 1:
        raise ValueError("test_ratio must be between 0 and 1")
    numbers = clusters.select("cluster").distinct()
    k = numbers.count()
    if not k:
        raise ValueError("clusters must not be empty")
    if clusters.count() != graph.n or clusters.join(graph.vertices, "id").count() != graph.n:
        raise ValueError("clusters must have the graph's vertices")
    ranked = numbered(numbers, "rank", F.md5(F.concat(F.lit(f"{0 if seed is None else seed}:"), F.col("cluster").cast("string"))), "cluster")
    chosen = ranked.where(F.col("rank") < test_count(test_ratio, k)).select("cluster")
    test = clusters.join(chosen, "cluster", "left_semi").select("id")
    train = clusters.join(chosen, "cluster", "left_anti").select("id")
    if post_filtering:
        beside = graph.sym.join(test.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct()
        train = train.join(beside, "id", "left_anti")
    return train, test
