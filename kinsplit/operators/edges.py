"""Edge tables with their vertices, and their files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsplit.config import INWeightType


class EdgeStore:
    """Vertices (id) and edges (src, dst, weight). Isolated vertices are only in the vertices."""

    def __init__(self, vertices: DataFrame | int, edges: DataFrame):
        self._edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double"))
        self.vertices = edges.sparkSession.range(vertices) if isinstance(vertices, int) else vertices.select(F.col("id").cast("long"))

    @property
    def edges(self) -> DataFrame:
        return self._edges

    @property
    def node_count(self) -> int:
        return self.vertices.count()

    def graph(self, inweight_type: INWeightType = INWeightType.Distance):
        from kinsplit.operators.graph import CsrGraph

        return CsrGraph(self, inweight_type)

    def __len__(self) -> int:
        return self._edges.count()

    def __getitem__(self, i: int) -> tuple[int, int, float]:
        """The i-th edge in order of src, dst, weight; negative numbers count from the end."""
        n = len(self)
        if not -n <= i < n:
            raise IndexError("edge index out of range")
        r = self._edges.orderBy("src", "dst", "weight").offset(i % n).limit(1).first()
        return r["src"], r["dst"], r["weight"]

    def __iter__(self) -> Iterator[tuple[int, int, float]]:
        return ((r["src"], r["dst"], r["weight"]) for r in self._edges.orderBy("src", "dst", "weight").toLocalIterator())

    def __str__(self) -> str:
        return f"EdgeStore(node_count={self.node_count}, edges={len(self)})"

    __repr__ = __str__

    def save(self, path: str) -> None:
        """By extension: .edgelist (text), .edgestr (records of 12 bytes), .parquet (a table); OSError otherwise."""
        from kinsplit.sources import edgelist

        edgelist.write(self, path)

    @staticmethod
    def load(path: str, spark: SparkSession | None = None) -> EdgeStore:
        from kinsplit.sources import edgelist

        return edgelist.read(spark or SparkSession.active(), path)
