from kinsplit.config import NormMode
from kinsplit.functions.structure import USAlignKernel

__all__ = ["NormMode", "USAlignKernel"]
