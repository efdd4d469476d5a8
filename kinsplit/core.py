"""Edges, graphs, clusters and the index, by the names of the public API."""

from kinsplit.config import HNSWConfig, INWeightType, LeidenObjective
from kinsplit.operators.ann import HNSWIndex, HNSWState
from kinsplit.operators.clusters import find_components, partition
from kinsplit.operators.communities import find_communities
from kinsplit.operators.edges import EdgeStore
from kinsplit.operators.graph import CsrGraph
from kinsplit.operators.proximity import exact_edges, exact_nearest_neighbors

__all__ = ["CsrGraph", "EdgeStore", "HNSWConfig", "HNSWIndex", "HNSWState", "INWeightType", "LeidenObjective", "exact_edges", "exact_nearest_neighbors", "find_communities", "find_components", "partition"]
