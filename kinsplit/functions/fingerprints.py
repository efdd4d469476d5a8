"""Bit and real fingerprints: local objects, and the columns they are in a DataFrame.

A bit fingerprint is a column ``array<int>`` of its distinct on-bits in order, or ``array<bigint>`` of packed words;
a real one is an array of numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, functions as F


def _rdkit():
    try:
        from rdkit import DataStructs
    except ImportError as e:
        raise RuntimeError("RDKit is needed for its own vector types and is not installed") from e
    return DataStructs


@dataclass
class BitFingerprint:
    """A fixed-length bit vector; accepts a list or array of booleans, or an RDKit ExplicitBitVect."""

    bits: np.ndarray = field(repr=False)

    def __init__(self, fp):
        if isinstance(fp, BitFingerprint):
            self.bits = fp.bits.copy()
        elif isinstance(fp, (np.ndarray, list, tuple)):
            a = np.asarray(fp)
            if a.ndim != 1 or (a.size and not np.isin(a, (0, 1)).all()):
                raise TypeError("a bit fingerprint is made of booleans")
            self.bits = a.astype(bool)
        elif type(fp).__name__ == "ExplicitBitVect":
            self.bits = np.array(list(fp), bool)
        else:
            raise TypeError(f"cannot make a bit fingerprint from {type(fp).__name__}; sparse vectors are not supported")

    @staticmethod
    def from_list(values) -> BitFingerprint:
        return BitFingerprint(list(values))

    @staticmethod
    def from_np(arr) -> BitFingerprint:
        return BitFingerprint(np.asarray(arr))

    from_rdkit = from_np

    @staticmethod
    def random(len: int, count: int) -> BitFingerprint:  # noqa: A002
        if count > len:
            raise ValueError("count must not exceed len")
        bits = np.zeros(len, bool)
        bits[np.random.default_rng().choice(len, count, replace=False)] = True
        return BitFingerprint(bits)

    def to_list(self) -> list[bool]:
        return self.bits.tolist()

    def to_np(self) -> np.ndarray:
        return self.bits.copy()

    def to_rdkit(self):
        v = _rdkit().ExplicitBitVect(len(self.bits))
        v.SetBitsFromList(np.flatnonzero(self.bits).tolist())
        return v

    def on_bits(self) -> list[int]:
        return np.flatnonzero(self.bits).tolist()

    def __len__(self) -> int:
        return len(self.bits)

    def count(self) -> int:
        return int(self.bits.sum())


LONGEST_COUNTS = 1 << 24


@dataclass
class RealFingerprint:
    """A dense vector of 32-bit floats with its squared norm; accepts numbers or RDKit count vectors."""

    data: np.ndarray = field(repr=False)

    def __init__(self, fp):
        if isinstance(fp, RealFingerprint):
            self.data = fp.data.copy()
        elif isinstance(fp, (np.ndarray, list, tuple)):
            a = np.asarray(fp)
            if a.ndim != 1 or not (np.issubdtype(a.dtype, np.number) or not a.size):
                raise TypeError("a real fingerprint is made of numbers")
            self.data = a.astype(np.float32)
        elif hasattr(fp, "GetNonzeroElements"):
            n = fp.GetLength()
            if n > LONGEST_COUNTS:
                raise TypeError(f"{type(fp).__name__} is too long for a dense vector; ULongSparseIntVect is not supported")
            self.data = np.zeros(n, np.float32)
            for k, v in fp.GetNonzeroElements().items():
                self.data[k] = v
        else:
            raise TypeError(f"cannot make a real fingerprint from {type(fp).__name__}")

    @staticmethod
    def from_list(values) -> RealFingerprint:
        return RealFingerprint(list(values))

    @staticmethod
    def from_np(arr) -> RealFingerprint:
        return RealFingerprint(np.asarray(arr))

    from_rdkit = from_np

    def to_list(self) -> list[float]:
        return self.data.tolist()

    def to_np(self) -> np.ndarray:
        return self.data.copy()

    def to_rdkit(self):
        v = _rdkit().IntSparseIntVect(len(self.data))
        for i in np.flatnonzero(self.data).tolist():
            v[i] = int(self.data[i])
        return v

    def __len__(self) -> int:
        return len(self.data)

    def norm_sq(self) -> float:
        return float(self.data.astype(np.float64) @ self.data.astype(np.float64))


# ---- columns


def on_bits(flags: Column) -> Column:
    """On-bit numbers of an array of booleans."""
    return F.array_compact(F.transform(flags, lambda b, i: F.when(b, i)))


def packed(bits: Column, n_bits: int) -> Column:
    """Words of 64 bits of an array of on-bit numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit((n_bits + 63) // 64 - 1)), lambda w: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int")))))


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def tanimoto_bit(a: Column, b: Column) -> Column:
    """1 - |A and B| / |A or B| of on-bit arrays; 0 where both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(0.0)).otherwise(F.lit(1.0) - common / union)


def tanimoto_words(a: Column, b: Column) -> Column:
    """The same of packed words; the intersection stops at the shorter word list."""
    n = F.least(F.size(a), F.size(b))
    common = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    union = popcount(a) + popcount(b) - common
    return F.when(union == 0, F.lit(0.0)).otherwise(F.lit(1.0) - common / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def tanimoto_real(a: Column, b: Column) -> Column:
    """1 - x.y / (|x|^2 + |y|^2 - x.y); 0 where the denominator is; over 1 where x.y is negative."""
    xy = dot(a, b)
    below = dot(a, a) + dot(b, b) - xy
    return F.when(below == 0, F.lit(0.0)).otherwise(F.lit(1.0) - xy / below)
