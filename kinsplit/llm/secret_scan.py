"""Secret scans with multipart credential linking.

Base findings are three kinds of spans by pattern. On top of them, weak parts are sought: access identifiers, opaque
secret values and endpoints, none of which says much by itself. Parts are intervals; so is the scope of each secret: its
line and SCOPE_LINES lines either way, within its block (blocks are parted by blank lines). Joining parts with the
scopes that hold them puts complementary parts together, and a weak secret is reported only where its scope also has an
identifier, a base finding or an endpoint; the identifiers and endpoints that it is linked to are reported with it.
Any endpoint completes an opaque value (OPAQUE characters or more, digits and letters of both cases). Shorter values,
those of one case, and pieces of an endpoint itself are weaker: they take an identifier, a base finding or an endpoint
that asks for credentials. Parts and scopes are both in order, so the join is one sweep over a text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from kinsplit.plans.names import column

# The base kinds in their order, with their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run is 20 characters or more from its first mark, or none in it is
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
LEAST_VALUE = 6

# Weak parts.
_ID = re.compile(r"""(?:client_?id|account_?id|access_?id|key_?id|user_?name|login|user)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
_VALUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,12}://[^\s\"'<>]+")
_DIGIT, _LETTER, _UPPER, _LOWER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]"), re.compile(r"[A-Z]"), re.compile(r"[a-z]")
OPAQUE = 32
_BLANK, _FEED = re.compile(r"\n[ \t\r]*\n"), re.compile(r"\n")
SCOPE_LINES = 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scopes(text: str, places: list[int]) -> list[tuple[int, int]]:
    """(start, end) of the scope of each place: its line and SCOPE_LINES lines either way, as far as its block goes."""
    blocks = [0, *(m.end() for m in _BLANK.finditer(text)), len(text) + 1]
    lines = [0, *(m.end() for m in _FEED.finditer(text))]
    out = []
    for at in places:
        block, line = bisect_right(blocks, at), bisect_right(lines, at) - 1
        end = lines[line + SCOPE_LINES + 1] if line + SCOPE_LINES + 1 < len(lines) else len(text) + 1
        out.append((max(blocks[block - 1], lines[max(0, line - SCOPE_LINES)]), min(blocks[block], end)))
    return out


def _end(span: tuple[int, int]) -> int:
    return span[1]


def _others(within: tuple[int, int], covered: tuple[int, int]) -> bool:
    """Whether a range of positions has any outside another one."""
    (i, j), (k, m) = within, covered
    return j - i > max(0, min(j, m) - max(i, k))


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of weak parts that complement one another or a base finding within a secret's scope."""
    secrets = [(m.start(), m.end()) for m in _VALUE.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]
    if not secrets:
        return []
    taken = [(s, e) for s, _, e in base]
    inside, k = [], 0
    for s, e in secrets:  # values that a base finding covers are no weak parts
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if not (k < len(taken) and taken[k][0] < e):
            inside.append((s, e))
    if not inside:
        return []
    ids = [(m.start(), m.end()) for m in _ID.finditer(text)]
    ends = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    asking = [(s, e) for s, e in ends if "@" in text[s:e]]
    strong = [(s, e) for s, kind, e in base if kind < 2]
    out, told = [], [0, 0]
    for (s, e), (a, b) in zip(inside, scopes(text, [s for s, _ in inside])):
        covered = (bisect_right(ids, s, key=_end), bisect_left(ids, (e,)))  # an identifier does not complement itself
        within = [(bisect_left(parts, (a,)), bisect_left(parts, (b,))) for parts in (ids, ends, asking, strong)]
        apart = bisect_right(ends, s, key=_end) == bisect_left(ends, (e,))
        opaque = apart and e - s >= OPAQUE and _UPPER.search(text, s, e) and _LOWER.search(text, s, e)
        if _others(within[0], covered) or any(i < j for i, j in within[1 if opaque else 2 :]):
            out.append((s, 4, e))
            for n, (parts, kind) in enumerate(((ids, 3), (ends, 5))):  # scopes are in order: what came before is there
                i, j = within[n]
                out += [(x, kind, y) for x, y in parts[max(i, told[n]) : j]]
                told[n] = j
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Whole texts, of any length; null counts as empty and has no spans (the digest of an empty string). Places are code
    points, ends exclusive. Rows with equal or null ids are rows of their own, and ids of any size stay exact. Other
    columns are not looked at, whatever their names. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for t in batch.column("text").to_pylist():
                t = t or ""
                base = base_spans(t)
                for kind, column_ in enumerate(counts):
                    column_.append(sum(k == kind for _, k, _ in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(sorted(base + linked_spans(t, base))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = df.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
