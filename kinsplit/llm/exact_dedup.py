"""Exact dedup: two passes over digests with Bloom filters of possibly repeated ones.

Pass 1 finds the possibly repeated hashes. Hashes are dealt by their bits into segments of bounded size, however many
rows there are; a segment's task counts its hashes in a two-plane Bloom filter ("seen" and "seen again") and then asks
that filter about each of them. A task sends a hash of its rows once a batch, so a hot text costs a few bytes.

Pass 2 asks about rows. The hashes that passed are put into one filter of at most ``max_filter_bytes``, the proven
bound of what is broadcast: rows that it does not know pass straight through, all others shuffle (as narrow digests, or
as documents when rows are dropped). The method is the same at any size. Where there are more repeated hashes than the
filter holds well, it lets more rows through to the shuffle, which costs work and changes no result.

Texts with very many copies (there can be few of them) are joined by broadcast, the others by shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinsplit.plans.hot import join_groups
from kinsplit.plans.names import column, columns, free
from kinsplit.plans.storage import materialize

SEGMENT_ROWS = 1 << 17  # hashes a segment, about
PROBES = 4
FLUSH = 500_000
CHUNK_BITS = 4096 * 8  # what bitmap_or_agg takes


def _places(h: np.ndarray, slots: int) -> np.ndarray:
    """(rows, PROBES) slots of a filter with ``slots`` slots, from bits that do not choose the segment."""
    u = h.view(np.uint64)
    a, b = (u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16), (u >> np.uint64(7)) | np.uint64(1)
    i = np.arange(PROBES, dtype=np.uint64)
    return ((a[:, None] + i * b[:, None]) % np.uint64(slots)).astype(np.int64)


def _dealt(segments: int):
    """Distinct hashes of a task's rows by segment: those met once, and those met again."""

    def emit(hs: list[np.ndarray]):
        h, n = np.unique(np.concatenate(hs), return_counts=True)
        seg = (h.view(np.uint64) % np.uint64(segments)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        h, n, seg = h[order], n[order], seg[order]
        for part in np.split(np.arange(len(h)), np.flatnonzero(np.diff(seg)) + 1):
            once, again = h[part][n[part] == 1], h[part][n[part] > 1]
            yield int(seg[part[0]]), once.tobytes(), again.tobytes()

    def run(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf["h"].to_numpy(np.int64))
            n += len(pdf)
            if n >= FLUSH:
                yield pd.DataFrame(list(emit(held)), columns=["seg", "once", "again"])
                held, n = [], 0
        if n:
            yield pd.DataFrame(list(emit(held)), columns=["seg", "once", "again"])

    return run


def _both_passes(slots: int):
    """The hashes of a segment that its filter has seen again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, again = np.zeros(slots, bool), np.zeros(slots, bool)
        for single, repeated in zip(pdf["once"], pdf["again"]):
            for raw, twice in ((single, False), (repeated, True)):
                p = _places(np.frombuffer(raw, np.int64), slots).ravel()
                p, n = np.unique(p, return_counts=True)
                again[p] |= seen[p] | twice | (n > 1)
                seen[p] = True
        found = [h[again[_places(h, slots)].all(axis=1)] for raw in (*pdf["once"], *pdf["again"]) for h in [np.frombuffer(raw, np.int64)]]
        return pd.DataFrame({"h": np.unique(np.concatenate(found))})

    return run


def _bitmaps(slots: int):
    """(chunk, bits): the places of a task's hashes, as bitmaps that are or-ed together."""

    def run(batches):
        bits = np.zeros(slots, bool)
        for pdf in batches:
            bits[_places(pdf["h"].to_numpy(np.int64), slots).ravel()] = True
        chunks = bits.reshape(-1, CHUNK_BITS)
        for k in np.flatnonzero(chunks.any(axis=1)).tolist():
            yield pd.DataFrame({"chunk": [k], "bits": [np.packbits(chunks[k], bitorder="little").tobytes()]})

    return run


def repeat_filter(hashes: DataFrame, rows: int, bits_per_row: int = 16, max_filter_bytes: int = 64 << 20):
    """A probe Column -> Column (boolean: may be repeated) for the long column ``h`` of ``hashes``."""
    segments = max(1, -(-rows // SEGMENT_ROWS))
    dealt = hashes.select("h").mapInPandas(_dealt(segments), "seg long, once binary, again binary")
    repeated = materialize(dealt.groupBy("seg").applyInPandas(_both_passes(SEGMENT_ROWS * bits_per_row), "h long"), "repeated")

    n = repeated.count()
    chunks = max(1, min(max_filter_bytes * 8, n * bits_per_row) // CHUNK_BITS + 1)
    slots = chunks * CHUNK_BITS
    parts = repeated.mapInPandas(_bitmaps(slots), "chunk int, bits binary").groupBy("chunk").agg(F.bitmap_or_agg("bits").alias("bits"))
    table = np.zeros(slots // 8, np.uint8)
    for r in parts.toLocalIterator():
        table[r["chunk"] * (CHUNK_BITS // 8) : (r["chunk"] + 1) * (CHUNK_BITS // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(table.tobytes())

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        bits = np.frombuffer(shared.value, np.uint8)
        s = _places(h.to_numpy(np.int64), slots)
        return pd.Series(((bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1).all(axis=1))

    return probe


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, unchanged; null counts as empty. The largest id of a group stays. A null id counts
    as smallest: it stays only where all ids of its group are null. Rows equal in id and text are each marked kept
    (:func:`drop_exact_duplicates` leaves one). Other columns are not looked at. An empty table gives no rows.
    """
    maybe, single, groups, _ = _grouped(df, id_col, text_col, bits_per_row, max_filter_bytes)
    alone = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    cols = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return join_groups(maybe, groups, "text_sha256", "group_size", maybe.count()).select(*cols).unionByName(alone)


def _grouped(df, id_col, text_col, bits_per_row, max_filter_bytes):
    """(rows that may be repeated, rows that are not, groups of the first, probe)."""
    rows = df.select(column(id_col).alias("doc_id"), F.sha2(F.coalesce(column(text_col), F.lit("")), 256).alias("text_sha256"))
    rows = materialize(rows.withColumn("h", F.xxhash64("text_sha256")), "digests")
    probe = repeat_filter(rows, rows.count(), bits_per_row, max_filter_bytes)
    flagged = materialize(rows.select("doc_id", "text_sha256", probe(F.col("h")).alias("maybe")), "flagged")
    maybe, single = flagged.where("maybe").drop("maybe"), flagged.where("not maybe").drop("maybe")
    groups = materialize(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return maybe, single, groups, probe


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """``df`` without all but the largest id of each group of equal texts (one of rows equal in id and text).

    Documents whose digest cannot be repeated pass straight through; only the others meet the ids that stay, by digest
    and id together, so the copies of one text spread. Columns keep their names, whatever they are.
    """
    _, _, groups, probe = _grouped(df, id_col, text_col, bits_per_row, max_filter_bytes)
    sha, maybe, of, keep = free(df, "_sha", "_maybe", "_of", "_keep")
    stay = groups.select(F.col("text_sha256").alias(of), F.col("keep_id").alias(keep))
    docs = df.withColumn(sha, F.sha2(F.coalesce(column(text_col), F.lit("")), 256)).withColumn(maybe, probe(F.xxhash64(sha)))
    meets = docs.where(maybe).join(stay, (F.col(sha) == F.col(of)) & column(id_col).eqNullSafe(F.col(keep)))
    meets = meets.dropDuplicates([sha, keep])
    return docs.where(~F.col(maybe)).select(*columns(df)).unionByName(meets.select(*columns(df)))
