"""Substitution matrices: BLOSUM62 and nucleotides here, others from files in the common text format."""

from __future__ import annotations

import os

import numpy as np

# BLOSUM62, lower triangle in this order of residues.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
LEAST = -4  # of a residue that the matrix does not know
# Nucleotide codes and the bases they stand for.
BASES = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def _table(pairs: dict[tuple[str, str], float], unknown: float) -> np.ndarray:
    """256 x 256 by byte, upper and lower case alike."""
    t = np.full((256, 256), unknown, np.int32)
    for (a, b), v in pairs.items():
        for x in {a, a.lower()}:
            for y in {b, b.lower()}:
                t[ord(x), ord(y)] = t[ord(y), ord(x)] = v
    return t


def _blosum62() -> np.ndarray:
    rows = [[int(v) for v in line.split()] for line in BLOSUM62.split("\n") if line]
    pairs = {(RESIDUES[i], RESIDUES[j]): v for i, row in enumerate(rows) for j, v in enumerate(row)}
    at = lambda a, b: pairs.get((a, b), pairs.get((b, a)))
    either = {"B": "ND", "Z": "QE", "J": "IL"}  # ambiguous residues score the mean of what they stand for
    codes = {**{r: r for r in RESIDUES}, **either}
    for a in either:
        for b in codes:
            pairs[a, b] = int(np.floor(np.mean([at(x, y) for x in codes[a] for y in codes[b]])))
    for b in [*codes, "X"]:
        pairs["X", b] = -1
    pairs["*", "*"] = 1
    return _table(pairs, LEAST)


def _nucleotides() -> np.ndarray:
    """Match 5, mismatch -4; ambiguous codes score the mean over their bases, rounded half away from zero; -1 for a code with itself or N with another code."""
    pairs = {}
    for a, x in BASES.items():
        for b, y in BASES.items():
            mean = np.mean([5 if p == q else -4 for p in x for q in y])
            special = len(x) > 1 and len(y) > 1 and (x == y or "N" in (a, b))
            pairs[a, b] = -1 if special else int(np.sign(mean) * np.floor(abs(mean) + 0.5))
    return _table(pairs, LEAST)


def read_matrix(text: str) -> np.ndarray:
    """A matrix in the common text format: # comments, a row of letters, then a letter and its scores in each row."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    heads = lines[0]
    return _table({(r[0], h): int(v) for r in lines[1:] for h, v in zip(heads, r[1:])}, min(int(v) for r in lines[1:] for v in r[1:]))


def matrix_table(matrix) -> np.ndarray:
    """The 256 x 256 table of a ScoringMatrix, of a dict {(a, b): score}, or of an array as it is.

    Matrices that are not built here are read from ``$KINSPLIT_MATRICES/<NAME>`` (such as BLOSUM80 or PAM250).
    """
    if isinstance(matrix, np.ndarray):
        return matrix
    if isinstance(matrix, dict):
        return _table(matrix, min(matrix.values()))
    name = matrix.name
    if name == "Blosum62":
        return _blosum62()
    if name in ("Dnafull", "Nuc44"):
        return _nucleotides()
    if name == "Identity":
        return np.eye(256, dtype=np.int32)
    folder = os.environ.get("KINSPLIT_MATRICES")
    if folder and os.path.exists(p := os.path.join(folder, name.upper())):
        with open(p) as f:
            return read_matrix(f.read())
    raise ValueError(f"{name} is not built in: put its file {name.upper()} into the folder that KINSPLIT_MATRICES names, or pass a dict of scores")


