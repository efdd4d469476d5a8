"""Choices and parameters of the public API."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from enum import Enum


class KernelVariant(Enum):
    """Which item type and distance a function works with."""

    AlignmentGlobal = "alignment_global"
    AlignmentLocal = "alignment_local"
    TanimotoBit = "tanimoto_bit"
    TanimotoReal = "tanimoto_real"
    Structure = "structure"


class INWeightType(Enum):
    """What an edge's raw weight means; see :func:`kinsplit.operators.graph.similarity`."""

    Similarity = "similarity"
    Distance = "distance"
    SimilarityComplement = "similarity_complement"
    Unweighted = "unweighted"


class LeidenObjective(Enum):
    Modularity = "modularity"
    CPM = "cpm"


class GlobalIdentityMode(Enum):
    """What matches are divided by. MaxLength is the largest of both lengths and the alignment's."""

    AlignmentLength = "alignment_length"
    MaxSeqLength = "max_seq_length"
    MinSeqLength = "min_seq_length"
    MaxLength = "max_length"


class LocalIdentityMode(Enum):
    AlignmentLength = "alignment_length"
    MinSeqLength = "min_seq_length"


class CoverageMode(Enum):
    """Which share has to reach ``min_coverage`` for a local alignment to count."""

    BothQueryTarget = 0
    Target = 1
    Query = 2
    LengthRatio = 3
    ShorterSeq = 4


class DatatypeWidth(Enum):
    """Accepted for compatibility; scores are 32-bit and do not saturate."""

    Short = 8
    Half = 16
    Full = 32
    Long = 64
    Sat = 0


class VectorizationStrategy(Enum):
    """Accepted for compatibility; alignments are vectorised over pairs and anti-diagonals."""

    Striped = "striped"
    Scan = "scan"
    Diag = "diag"


class NormMode(Enum):
    """Which structure's length a TM-score is normalised by; Min takes the smaller of both scores."""

    Min = "min"
    Query = "query"
    Target = "target"


# The families of substitution matrices are a rule: names and numbers.
ScoringMatrix = Enum("ScoringMatrix", {n: n.lower() for n in ["Identity", "Dnafull", "Nuc44", *[f"Blosum{i}" for i in [*range(30, 65, 5), 62, *range(65, 105, 5)]], *[f"Pam{i}" for i in range(10, 510, 10)]]})


@dataclass(frozen=True)
class HNSWConfig:
    """Parameters of the approximate index. The cache and thread settings are accepted and not needed here."""

    proximity_threshold: float = 0.5
    ef_construction: int = 64
    m: int = 16
    m_max: int = 16
    m_max0: int = 32
    m_l: float = 0.36
    ef_init: int = 1
    extend_candidates: bool = False
    keep_pruned_connections: bool = True
    keep_all_edges: bool = True
    cache_capacity: int = 2_000_000
    cache_shards: int = 64
    n_threads: int = 0
    shuffle: bool = False
    use_heuristic: bool = True
    strict_ef: bool = False
    threshold_based_neighbourhood: bool = False

    def dict(self) -> dict:
        return asdict(self)

    def __str__(self) -> str:
        return "HNSWConfig(" + ", ".join(f"{k}={v}" for k, v in asdict(self).items()) + ")"

    __repr__ = __str__
