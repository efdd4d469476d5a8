from kinsplit.config import CoverageMode, DatatypeWidth, GlobalIdentityMode, LocalIdentityMode, ScoringMatrix, VectorizationStrategy
from kinsplit.functions.alignment import GlobalAligner, LocalAligner

__all__ = ["CoverageMode", "DatatypeWidth", "GlobalAligner", "GlobalIdentityMode", "LocalAligner", "LocalIdentityMode", "ScoringMatrix", "VectorizationStrategy"]
