"""Item types, readers and small helpers, by the names of the public API."""

from kinsplit.functions.fingerprints import BitFingerprint, RealFingerprint
from kinsplit.functions.structure import PdbStructure
from kinsplit.operators.clusters import largest_cluster
from kinsplit.sources.sequences import read_fasta

__all__ = ["BitFingerprint", "PdbStructure", "RealFingerprint", "largest_cluster", "read_fasta"]
