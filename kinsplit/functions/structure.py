"""Protein structures: PDB text to C-alpha traces, and a TM-score by superposition.

The aligner that others use for this is native code. Here pairs of residues come from ungapped fragment threading and
are refined by superposing (Kabsch) and re-aligning by dynamic programming on the TM term, keeping the best score. It
is the published scheme in short form, so scores can be a little below those of the full search.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from kinsplit.config import NormMode

# Residue names and their letters.
LETTERS = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
LEAST_RESIDUES = 3


def parse_pdb(text: str) -> tuple[str, np.ndarray]:
    """(letters, coordinates n x 3) of the first model's C-alpha atoms; alternate places other than blank and A are skipped."""
    letters, xyz = [], []
    for line in text.splitlines():
        if line.startswith("ENDMDL"):
            break
        if line[:6] in ("ATOM  ", "HETATM") and line[12:16].strip() == "CA" and line[16:17] in (" ", "A") and (line[:6] == "ATOM  " or line[17:20] == "MSE"):
            letters.append(LETTERS.get(line[17:20], "X"))
            xyz.append([float(line[30:38]), float(line[38:46]), float(line[46:54])])
    return "".join(letters), np.array(xyz, float).reshape(-1, 3)


@dataclass
class PdbStructure:
    """A structure from a PDB file that is not compressed; RuntimeError if it cannot be read or has under 3 residues."""

    path: str
    seq: str = field(init=False)
    xyz: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        try:
            with open(self.path) as f:
                self.seq, self.xyz = parse_pdb(f.read())
        except (OSError, ValueError, UnicodeDecodeError) as e:
            raise RuntimeError(f"cannot read the structure {self.path}: {e}") from e
        if len(self.seq) < LEAST_RESIDUES:
            raise RuntimeError(f"{self.path} has fewer than {LEAST_RESIDUES} residues")


def superpose(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift that bring x nearest to y."""
    cx, cy = x.mean(axis=0), y.mean(axis=0)
    u, _, vt = np.linalg.svd((x - cx).T @ (y - cy))
    turn = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    r = u @ turn @ vt
    return r, cy - cx @ r


def scale_length(n: int) -> float:
    """The distance scale d0 of a chain of n residues."""
    return max(0.5, 1.24 * np.cbrt(n - 15) - 1.8) if n > 21 else 0.5


def _aligned(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the best monotone alignment of a score matrix, gaps free."""
    n, m = score.shape
    total = np.zeros((n + 1, m + 1))
    for i in range(n):
        total[i + 1, 1:] = np.maximum(total[i, 1:], total[i, :-1] + score[i])
        np.maximum.accumulate(total[i + 1], out=total[i + 1])
    i, j, pairs = n, m, []
    while i and j:
        if total[i, j] == total[i - 1, j]:
            i -= 1
        elif total[i, j] == total[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    p = np.array(pairs[::-1], np.int64).reshape(-1, 2)
    return p[:, 0], p[:, 1]


def tm_scores(x: np.ndarray, y: np.ndarray, rounds: int = 12) -> tuple[float, float]:
    """(TM by the length of x, TM by the length of y)."""
    n, m = len(x), len(y)
    if min(n, m) < LEAST_RESIDUES:
        return 0.0, 0.0
    d0 = scale_length(min(n, m))
    short = min(n, m)
    shifts = range(-(n - max(3, short // 2)), m - max(3, short // 2) + 1, max(1, short // 20))
    starts = []
    for s in shifts:
        i = np.arange(max(0, -s), min(n, m - s))
        if len(i) >= LEAST_RESIDUES:
            r, t = superpose(x[i], y[i + s])
            d2 = ((x[i] @ r + t - y[i + s]) ** 2).sum(axis=1)
            starts.append((float((1 / (1 + d2 / d0**2)).sum()), s))
    best = [0.0, 0.0]
    for _, s in sorted(starts, reverse=True)[:5]:
        i = np.arange(max(0, -s), min(n, m - s))
        j = i + s
        for _ in range(rounds):
            r, t = superpose(x[i], y[j])
            for _ in range(3):  # superpose again on what lies near
                d2 = ((x[i] @ r + t - y[j]) ** 2).sum(axis=1)
                near = d2 < max(64.0, d0**2)
                if near.sum() < LEAST_RESIDUES:
                    break
                r, t = superpose(x[i][near], y[j][near])
            d2 = ((x[i] @ r + t - y[j]) ** 2).sum(axis=1)
            for k, size in enumerate((n, m)):
                best[k] = max(best[k], float((1 / (1 + d2 / scale_length(size) ** 2)).sum() / size))
            moved = x @ r + t
            all2 = ((moved[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
            i2, j2 = _aligned(1 / (1 + all2 / d0**2))
            if len(i2) < LEAST_RESIDUES or (len(i2) == len(i) and (i2 == i).all() and (j2 == j).all()):
                break
            i, j = i2, j2
    return min(1.0, best[0]), min(1.0, best[1])


@dataclass(frozen=True)
class USAlignKernel:
    """1 - TM-score of two structures. ``fast`` refines fewer rounds."""

    norm_mode: NormMode = NormMode.Min
    fast: bool = True

    def of_coordinates(self, ref: np.ndarray, query: np.ndarray) -> float:
        tm_query, tm_ref = tm_scores(query, ref, 6 if self.fast else 20)
        return 1 - {NormMode.Min: min(tm_query, tm_ref), NormMode.Query: tm_query, NormMode.Target: tm_ref}[self.norm_mode]

    def call(self, ref_sample: PdbStructure, query: PdbStructure) -> float:
        return self.of_coordinates(ref_sample.xyz, query.xyz)

    __call__ = call
