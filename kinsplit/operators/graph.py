"""Weighted undirected graphs as symmetric edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinsplit.config import INWeightType
from kinsplit.operators.edges import EdgeStore


def similarity(weight: Column, kind: INWeightType) -> Column:
    """The edge weight of a raw weight."""
    return {INWeightType.Similarity: weight, INWeightType.Distance: 1 / (1 + weight), INWeightType.SimilarityComplement: 1 - weight, INWeightType.Unweighted: F.lit(1.0)}[kind]


class CsrGraph:
    """Neighbours by vertex: ``sym`` (v, u, w) has each edge from both ends, a self-loop once; parallel edges stay."""

    def __init__(self, edges: EdgeStore, inweight_type: INWeightType = INWeightType.Distance):
        self.store, self.inweight_type = edges, inweight_type
        self.vertices = edges.vertices
        w = edges.edges.select("src", "dst", similarity(F.col("weight"), inweight_type).alias("w"))
        self.weighted = w
        back = w.where("src <> dst").select(F.col("dst").alias("v"), F.col("src").alias("u"), "w")
        self.sym = w.select(F.col("src").alias("v"), F.col("dst").alias("u"), "w").unionByName(back)

    @property
    def n(self) -> int:
        return self.vertices.count()

    @property
    def m(self) -> float:
        """The sum of raw weights, before their conversion."""
        return self.store.edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]

    @property
    def total_weight(self) -> float:
        return self.weighted.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]

    def neighbors(self, v: int) -> list[tuple[int, float]]:
        return [(r["u"], r["w"]) for r in self.sym.where(F.col("v") == v).orderBy("u", "w").collect()]

    def adjacency(self) -> DataFrame:
        """(id, neighbors) of every vertex."""
        near = self.sym.groupBy(F.col("v").alias("id")).agg(F.sort_array(F.collect_list(F.struct("u", "w"))).alias("neighbors"))
        return self.vertices.join(near, "id", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<struct<u:bigint,w:double>>")))

    def degrees(self) -> DataFrame:
        """(id, degree) of every vertex: the length of its list in :meth:`adjacency`, without making the lists."""
        n = self.sym.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def strength(self, v: int) -> float:
        return self.sym.where(F.col("v") == v).agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]

    def strengths(self) -> DataFrame:
        """(id, strength) of every vertex; 0 without edges."""
        s = self.sym.groupBy(F.col("v").alias("id")).agg(F.sum("w").alias("strength"))
        return self.vertices.join(s, "id", "left").select("id", F.coalesce("strength", F.lit(0.0)).alias("strength"))

    def subgraph(self, nodes: list[int] | DataFrame) -> tuple[CsrGraph, DataFrame]:
        """The graph induced by ``nodes``, renumbered, and (old_id, new_id).

        A list is numbered by place and must not repeat a node; a DataFrame gives (old_id, new_id) itself.
        """
        if isinstance(nodes, DataFrame):
            mapping = nodes.select("old_id", "new_id")
        else:
            if len(set(nodes)) != len(nodes):
                raise ValueError("subgraph nodes must not repeat")
            mapping = self.vertices.sparkSession.createDataFrame([(int(v), i) for i, v in enumerate(nodes)], "old_id long, new_id long")
        a, b = mapping.select(F.col("old_id").alias("src"), F.col("new_id").alias("s")), mapping.select(F.col("old_id").alias("dst"), F.col("new_id").alias("d"))
        kept = self.weighted.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), F.col("w").alias("weight"))
        return CsrGraph(EdgeStore(mapping.select(F.col("new_id").alias("id")), kept), INWeightType.Similarity), mapping

    def __str__(self) -> str:
        return f"CsrGraph(n={self.n}, m={self.m})"

    __repr__ = __str__
