"""``python -m kinsplit.bench_communities FILE``: seconds that communities of an edge file take."""

import sys
import time

from pyspark.sql import SparkSession

from kinsplit.config import INWeightType, LeidenObjective
from kinsplit.operators.communities import find_communities
from kinsplit.operators.edges import EdgeStore


def main(path: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    graph = EdgeStore.load(path, spark).graph(INWeightType.SimilarityComplement)
    began = time.time()
    n = find_communities(graph, gamma=1.0, beta=0.01, n_iterations=2, objective=LeidenObjective.Modularity).select("cluster").distinct().count()
    print(f"{n} communities in {time.time() - began:.2f} s")


if __name__ == "__main__":
    main(sys.argv[1])
