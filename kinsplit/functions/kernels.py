"""Distance kernels behind one face: how items are held, what size prunes by, and distances of blocks and of pairs.

A kernel's items are one column of a DataFrame:
  AlignmentGlobal, AlignmentLocal   string
  TanimotoBit                       array<int> of distinct on-bits
  TanimotoReal                      array of numbers, all of one length
  Structure                         PDB text
User kernels are objects with the methods of :class:`Kernel`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from kinsplit.config import KernelVariant
from kinsplit.functions import fingerprints as fp
from kinsplit.functions.alignment import GlobalAligner, LocalAligner
from kinsplit.functions.structure import USAlignKernel, parse_pdb


class Kernel:
    """``size``: a number per item; ``bound``: the most similarity (1 - distance) that two sizes allow."""

    rows_per_block = 2000
    most_blocks = None  # of the items of one side; with more rows, blocks grow, up to blocks.MOST_ROWS
    edge_blocks = None  # as ``most_blocks``, where a table meets itself and each block is copied for all others
    most_size = None  # of the items of a block together
    chunk = None  # rows of a block that ``near`` and ``nearest`` get at once, where that is not proximity.CHUNK
    column = None  # (Column, Column) -> Column where Catalyst can say the distance

    def size(self, item: Column) -> Column:
        return F.lit(0.0)

    def bound(self, small: float, large: float) -> float:
        return 1.0

    def load(self, items: list) -> object:
        return items

    def load_column(self, items: pa.ChunkedArray) -> object:
        return self.load(items.to_pandas().tolist())

    def block(self, refs, queries) -> np.ndarray:
        """Distances, refs by queries."""
        raise NotImplementedError

    def near(self, refs, queries, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, distance) of the pairs under the threshold."""
        d = self.block(refs, queries)
        i, j = np.nonzero(d < threshold)
        return i, j, d[i, j]

    def nearest(self, refs, queries, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the k nearest queries of each ref, ties by the lower place."""
        d = self.block(refs, queries)
        top = np.argsort(d, axis=1, kind="stable")[:, :k]
        return top, np.take_along_axis(d, top, 1)

    def pairs(self, refs, queries, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of the refs ``i`` and the queries ``j``, one by one."""
        some = lambda x, at: x[at] if isinstance(x, np.ndarray) else [x[a] for a in at.tolist()]
        out, order = np.empty(len(i)), np.argsort(j, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(j[order])) + 1) if len(i) else ():
            out[at] = self.block(some(refs, i[at]), some(queries, j[at[:1]]))[:, 0]
        return out

    def zipped(self, refs: list, queries: list) -> np.ndarray:
        return np.array([self.block(self.load([r]), self.load([q]))[0, 0] for r, q in zip(refs, queries)], float)


@dataclass
class TanimotoReal(Kernel):
    """In ``near`` and ``nearest``, products of single precision rule out pairs by more than their error; the rest is computed in full."""

    most_blocks, edge_blocks = 48, 16
    column = staticmethod(fp.tanimoto_real)

    def size(self, item):
        return fp.dot(item, item)

    def bound(self, small, large):
        # similarity is at most r / (1 + r^2 - r) with r the ratio of norms
        r = np.sqrt(small / large) if large > 0 else 1.0
        return float(r / (1 + r * r - r))

    def load(self, items):
        return np.array([np.asarray(x, float) for x in items], float) if len(items) else np.zeros((0, 0))

    def block(self, refs, queries):
        xy = refs @ queries.T
        below = (refs**2).sum(axis=1)[:, None] + (queries**2).sum(axis=1)[None, :] - xy
        return np.where(below == 0, 0.0, 1 - xy / np.where(below == 0, 1, below))

    def load_column(self, items):
        lists = items.combine_chunks()
        n, flat = len(lists), lists.flatten()
        if not n or lists.null_count or flat.null_count or (np.diff(lists.offsets.to_numpy()) * n != len(flat)).any():
            return super().load_column(items)
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)

    def pairs(self, refs, queries, i, j):
        return self._pairs(refs, queries, (refs**2).sum(axis=1), (queries**2).sum(axis=1), i, j)

    def _pairs(self, refs, queries, a, b, i, j) -> np.ndarray:
        """Distances of pairs; a and b are the squared norms."""
        out, step = np.empty(len(i)), max(1, (1 << 17) // max(1, refs.shape[1]))
        for s in range(0, len(i), step):
            p, q = i[s : s + step], j[s : s + step]
            xy = np.einsum("ij,ij->i", refs[p], queries[q])
            below = a[p] + b[q] - xy
            out[s : s + step] = np.where(below == 0, 0.0, 1 - xy / np.where(below == 0, 1, below))
        return out

    def near(self, refs, queries, threshold):
        if not len(refs) or not len(queries):
            return super().near(refs, queries, threshold)
        a, b = (refs**2).sum(axis=1), (queries**2).sum(axis=1)
        # under the threshold: (2 - t) xy > (1 - t) (a + b); slack is some times the error of the product, as a share of a + b
        both, one = 2 - threshold, 1 - threshold
        slack = (refs.shape[1] + 16) * 2e-7 * (abs(both) + abs(one))
        if slack > 0.1 or not max(a.max(), b.max()) < 1e30:
            return super().near(refs, queries, threshold)
        left = np.column_stack([both * refs, (slack - one) * a, np.ones(len(a))]).astype(np.float32)
        right = np.column_stack([queries, np.ones(len(b)), (slack - one) * b]).astype(np.float32)
        i, j = np.divmod(np.flatnonzero(left @ right.T >= np.float32(-1e-35)), len(b))
        d = self._pairs(refs, queries, a, b, i, j)
        kept = d < threshold
        return i[kept], j[kept], d[kept]

    def nearest(self, refs, queries, k):
        n = len(queries)
        first = max(8 * k, n // 16)
        if not len(refs) or k < 1 or n < 2 * first:
            return super().nearest(refs, queries, k)
        a, b = (refs**2).sum(axis=1), (queries**2).sum(axis=1)
        slack = (refs.shape[1] + 16) * 2e-6
        if slack > 0.1 or not (1e-30 < min(a.min(), b.min()) and max(a.max(), b.max()) < 1e30):
            return super().nearest(refs, queries, k)
        some = refs @ queries[:first].T
        some /= a[:, None] + b[None, :first] - some
        least = np.partition(some, first - k, axis=1)[:, first - k] - slack  # k of the first are at least this much alike
        left = np.column_stack([(1 + least)[:, None] * refs, -least * a, -least]).astype(np.float32)
        right = np.column_stack([queries, np.ones(n), b]).astype(np.float32)
        # xy / (a + b - xy) >= least, but for the error of the product, which is a share of the greatest a and b
        error = (slack / 4 * (a + b.max())).astype(np.float32)
        i, j = np.divmod(np.flatnonzero(left @ right.T >= -error[:, None]), n)
        d = self._pairs(refs, queries, a, b, i, j)
        order = np.lexsort((j, d, i))
        starts = np.searchsorted(i, np.arange(len(refs)))  # i is in order, and stays so
        at = order[starts[:, None] + np.arange(k)]
        return j[at], d[at]

    def call(self, a, b) -> float:
        a, b = (x.data if isinstance(x, fp.RealFingerprint) else x for x in (a, b))
        return float(self.block(self.load([a]), self.load([b]))[0, 0])

    __call__ = call


class Sets:
    """Sets of long numbers, one after another."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        self.flat, self.n = flat, np.diff(ends)
        self.ends = ends - ends[0]

    def __len__(self) -> int:
        return len(self.n)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The numbers of the sets ``rows``, one after another."""
        return self.flat[_ranges(self.ends[rows], self.n[rows])]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of n numbers each, one after another."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(first - (ends - n), n)


def _hashed(sets: Sets, width: int, first: int, last: int) -> np.ndarray:
    """Sets first to last as counts of their numbers by hash."""
    flat = sets.flat[sets.ends[first] : sets.ends[last]]
    at = ((flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & (width - 1)
    at += np.repeat(np.arange(last - first), sets.n[first:last]) * width
    return np.bincount(at, minlength=(last - first) * width).astype(np.float32).reshape(last - first, width)


HASHED_BYTES, PRODUCTS = 64 << 20, 4_000_000  # of a matrix of counts, and of two


@dataclass
class TanimotoBit(Kernel):
    """In ``near``, products of counts by hash, which are no less than what two sets share, rule out pairs."""

    most_blocks, most_size, chunk = 48, 8_000_000, 2000
    column = staticmethod(fp.tanimoto_bit)

    def size(self, item):
        return F.size(item).cast("double")

    def bound(self, small, large):
        return small / large if large > 0 else 1.0

    def load(self, items):
        return [frozenset(x) for x in items]

    def load_column(self, items):
        lists = items.combine_chunks()
        if isinstance(lists, pa.ChunkedArray):  # as of no chunk
            return Sets(np.zeros(0, np.int64), np.zeros(1, np.int64))
        return Sets(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64))

    def near(self, refs: Sets, queries: Sets, threshold):
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if not len(refs) or not len(queries):
            return out[0]
        largest = int(max(refs.n.max(), queries.n.max(), 32))
        width = 1 << min(15, (6 * largest).bit_length())
        share = (1 - threshold) / (2 - threshold) if threshold < 1 else 0.0  # of both sizes, that a pair has to have in common
        step = max(1, HASHED_BYTES // (4 * width))
        for r in range(0, len(refs), step):
            x = _hashed(refs, width, r, min(r + step, len(refs)))
            some = min(step, max(1, PRODUCTS // len(x)))
            for q in range(0, len(queries), some):
                last = min(q + some, len(queries))
                most = x @ _hashed(queries, width, q, last).T
                least = (share * (refs.n[r : r + len(x), None] + queries.n[None, q:last]) * (1 - 1e-5) - 1e-3).astype(np.float32)
                a, b = np.divmod(np.flatnonzero(most >= least), last - q)
                for i in np.unique(a):
                    j = b[np.searchsorted(a, i) : np.searchsorted(a, i, "right")] + q
                    d = self._from(refs, r + int(i), queries, j)
                    kept = d < threshold
                    out.append((np.full(kept.sum(), r + int(i)), j[kept], d[kept]))
        return tuple(np.concatenate(c) for c in zip(*out))

    @staticmethod
    def _from(refs: Sets, i: int, queries: Sets, j: np.ndarray) -> np.ndarray:
        """Distances of one set to some, counted in pieces of bounded size."""
        own, out = np.sort(refs.of(np.array([i]))), np.empty(len(j))
        step = max(1, (1 << 22) // max(1, int(queries.n[j].max(initial=1))))
        for s in range(0, len(j), step):
            p = j[s : s + step]
            common = np.zeros(len(p))
            if len(own):
                flat = queries.of(p)
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                common = np.bincount(np.repeat(np.arange(len(p)), queries.n[p])[hit], minlength=len(p)).astype(float)
            union = len(own) + queries.n[p] - common
            out[s : s + step] = np.where(union == 0, 0.0, 1 - common / np.maximum(union, 1))
        return out

    def nearest(self, refs: Sets, queries: Sets, k):
        """Counts through an index of what the refs hold."""
        known, n = np.unique(refs.flat), len(queries)
        at = np.minimum(np.searchsorted(known, queries.flat), max(0, len(known) - 1))
        hit = known[at] == queries.flat if len(known) else np.zeros(len(at), bool)
        at, where = at[hit], np.repeat(np.arange(n), queries.n)[hit]
        order = np.argsort(at, kind="stable")
        where, starts = where[order], np.searchsorted(at[order], np.arange(len(known) + 1))
        d = np.empty((len(refs), n))
        for i in range(len(refs)):
            own = np.searchsorted(known, refs.of(np.array([i])))
            common = np.bincount(where[_ranges(starts[own], starts[own + 1] - starts[own])], minlength=n)
            union = refs.n[i] + queries.n - common
            d[i] = np.where(union == 0, 0.0, 1 - common / np.maximum(union, 1))
        top = np.argsort(d, axis=1, kind="stable")[:, :k]
        return top, np.take_along_axis(d, top, 1)

    def block(self, refs, queries):
        """Counts of common bits through an index of the queries' bits."""
        at: dict[int, list[int]] = {}
        for j, q in enumerate(queries):
            for b in q:
                at.setdefault(b, []).append(j)
        sizes = np.array([len(q) for q in queries], float)
        out = np.empty((len(refs), len(queries)))
        for i, r in enumerate(refs):
            common = np.zeros(len(queries))
            for b in r:
                if b in at:
                    common[at[b]] += 1
            union = len(r) + sizes - common
            out[i] = np.where(union == 0, 0.0, 1 - common / np.maximum(union, 1))
        return out

    def call(self, a, b) -> float:
        if isinstance(a, fp.BitFingerprint):
            a, b = a.on_bits(), b.on_bits()
        return float(self.block(self.load([a]), self.load([b]))[0, 0])

    __call__ = call


class _Alignment(Kernel):
    rows_per_block = 300

    def __init__(self, aligner):
        self.aligner = aligner

    def size(self, item):
        return F.octet_length(item).cast("double")

    def bound(self, small, large):
        return float(self.aligner.size_bound(small, large)) if large > 0 else 1.0

    def block(self, refs, queries):
        r = [x for x in refs for _ in queries]
        return self.aligner.distances(r, list(queries) * len(refs)).reshape(len(refs), len(queries))

    def zipped(self, refs, queries):
        return self.aligner.distances(list(refs), list(queries))


class _Structures(Kernel):
    rows_per_block = 60

    def __init__(self, kernel: USAlignKernel):
        self.kernel = kernel

    def load(self, items):
        return [parse_pdb(x)[1] for x in items]

    def block(self, refs, queries):
        return np.array([[self.kernel.of_coordinates(r, q) for q in queries] for r in refs], float).reshape(len(refs), len(queries))


def make_kernel(variant, *args, **kwargs) -> Kernel:
    """The kernel of a variant, built with the given arguments; a Kernel is taken as it is."""
    if isinstance(variant, Kernel):
        return variant
    return {
        KernelVariant.AlignmentGlobal: lambda: _Alignment(GlobalAligner(*args, **kwargs)),
        KernelVariant.AlignmentLocal: lambda: _Alignment(LocalAligner(*args, **kwargs)),
        KernelVariant.TanimotoBit: lambda: TanimotoBit(*args, **kwargs),
        KernelVariant.TanimotoReal: lambda: TanimotoReal(*args, **kwargs),
        KernelVariant.Structure: lambda: _Structures(USAlignKernel(*args, **kwargs)),
    }[variant]()
