"""kinsplit: thresholded proximity graphs and leakage-free splits on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the Python workers by value, so executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from kinsplit.config import CoverageMode, DatatypeWidth, GlobalIdentityMode, HNSWConfig, INWeightType, KernelVariant, LeidenObjective, LocalIdentityMode, NormMode, ScoringMatrix, VectorizationStrategy  # noqa: E402
from kinsplit.functions.alignment import GlobalAligner, LocalAligner  # noqa: E402
from kinsplit.functions.fingerprints import BitFingerprint, RealFingerprint  # noqa: E402
from kinsplit.functions.kernels import TanimotoBit, TanimotoReal  # noqa: E402
from kinsplit.functions.structure import PdbStructure, USAlignKernel  # noqa: E402
from kinsplit.operators.ann import HNSWIndex, HNSWState  # noqa: E402
from kinsplit.operators.clusters import find_components, largest_cluster, partition  # noqa: E402
from kinsplit.operators.communities import find_communities  # noqa: E402
from kinsplit.operators.edges import EdgeStore  # noqa: E402
from kinsplit.operators.graph import CsrGraph  # noqa: E402
from kinsplit.operators.proximity import exact_edges, exact_nearest_neighbors, zip_kernel  # noqa: E402
from kinsplit.sources.sequences import read_fasta, read_molecule_file  # noqa: E402

__all__ = [n for n in dir() if not n.startswith("_")]
