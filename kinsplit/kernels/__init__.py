"""Kernels by the names of the public API."""

from kinsplit.config import KernelVariant
from kinsplit.operators.proximity import zip_kernel

__all__ = ["KernelVariant", "zip_kernel"]
