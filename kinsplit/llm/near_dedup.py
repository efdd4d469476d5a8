"""MinHash near-dedup: ProbMinHash signatures of weighted word shingles, banding, and exact verification.

A document is the multiset of its five-word shingles (words: runs without ASCII white space, lower case; a shorter
text with any word is one shingle). The similarity is the probability Jaccard index of the shingle counts,
J_P(a, b) = sum_d 1 / sum_e max(a_e / a_d, b_e / b_d), which is the plain Jaccard index where no shingle repeats.
Documents are linked where J_P is at least the threshold, and classes are the connected components.

ProbMinHash: every shingle sends exponentially spaced arrivals (a Poisson process with the count as its rate) to random
registers; a register keeps its first. A shingle stops as soon as its next arrival is later than the latest register,
so the work is near the number of shingles, not shingles times registers. Two documents agree in a register with
probability J_P.

Texts equal after lower-casing meet first and go on as one node. In each bucket of a band the smallest node is the
pivot all others are compared with; pivots then leave their bucket, buckets whose members are already of one class
are done, and the next round takes the next pivot. So a large class takes linear work and no group is expanded into
pairs. Buckets that stay open after ``pivot_rounds`` mostly hold documents that share a frequent passage and little
else. Their documents meet anew, exactly, on their rarest shingles: J_P of at least t means that the common shingles
have at least the share t of either document's weight, so two such documents share one of the rarest shingles that
make up more than 1 - t of each (a prefix filter).

1 - J_P is a metric (the chance that a consistent sample differs). A large class therefore stands for itself by its
stars, pivots with the members verified against them: a document at similarity s to a star's pivot can only be linked
to members at similarity 1 - (t - s) or less to that pivot, so most documents are done after one comparison a star, on
narrow pairs. Where members are left to compare, and in buckets of many documents of small classes, blocks of documents
meet: each of k documents in such a bucket is sent once for every WIDE others, which is what an exact answer about
documents that are all nearly alike and of no common class still costs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinsplit.operators.components import star_forest
from kinsplit.plans.hot import hot_limit, join_groups
from kinsplit.plans.names import column, free
from kinsplit.plans.storage import materialize, release

BANDS, ROWS = 28, 5
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C55
SLAB = 4 << 20  # bytes of text hashed at a time
PAIRS_PER_TASK, MOST_TASKS = 2_000, 20_000
SLOTS = 1 << 20  # counters that order shingles by frequency: 4 MB, whatever the input; any order gives whole results
SEGMENT = 1 << 14
BLOCK, PROBES = 250, 4_000  # documents of a star held together, and documents compared with them, a task; classes over BLOCK are large
WIDE = 1_000  # documents of a bucket held together
FEW = 16  # documents of a bucket that are compared as pairs


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    with np.errstate(over="ignore"):
        up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
        up[1:], down[1:] = _BASE, pow(_BASE, -1, 1 << 64)
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Shingler:
    """Shingle hashes of a block of texts, in array operations over their bytes."""

    def __init__(self, size: int = 5):
        self.size, self.tables = size, _powers(1 << 16)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each shingle, its hash) of texts data[starts[i]:ends[i]], which follow one another."""
        lo, hi = int(starts[0]), int(ends[-1])
        b = data[lo:hi]
        if len(self.tables[0]) < len(b) + 1:
            self.tables = _powers(len(b) + 1)
        up, down = self.tables
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edge = np.zeros(len(b) + 1, bool)  # a text's start ends a word of the text before
        edge[starts - lo] = True
        first = np.flatnonzero((inside[1:-1] == 1) & ((inside[:-2] == 0) | edge[:-1]))
        last = np.flatnonzero((inside[1:-1] == 1) & ((inside[2:] == 0) | edge[1:])) + 1
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
            word = _mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _C1)
            row = np.searchsorted(starts - lo, first, side="right") - 1
            k = self.size
            n = len(word)
            acc = np.zeros(max(0, n - k + 1), np.uint64)
            for i in range(k if n >= k else 0):
                acc = _mix(acc * _C1 + word[i : n - k + 1 + i])
            good = row[: len(acc)] == row[k - 1 :] if len(acc) else np.zeros(0, bool)
            rows, out = row[: len(acc)][good], acc[good]
            # shorter texts: all their words are one shingle
            count = np.bincount(row, minlength=len(starts))
            short = np.flatnonzero((count > 0) & (count < k))
            if len(short):
                at = np.searchsorted(row, short)
                h = np.zeros(len(short), np.uint64)
                for i in range(k - 1):
                    has = count[short] > i
                    h[has] = _mix(h[has] * _C1 + word[at[has] + i] + np.uint64(7))
                rows, out = np.concatenate([rows, short]), np.concatenate([out, h])
        return rows, out


def _weighted(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in order, and counts."""
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return rows[at], h[at], np.diff(np.append(at, len(h)))


def probminhash(rows: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m) signature: in each register the hash of the shingle that arrived first; 0 in rows without shingles."""
    sig = np.zeros(n_rows * m, np.uint64)
    best = np.full(n_rows * m, np.inf)
    t = np.zeros(len(h))
    rate = 1.0 / weight
    live = np.arange(len(h))
    with np.errstate(over="ignore"):
        i = 0
        while len(live):
            i += 1
            u = _mix(h[live] + np.uint64(i) * _C1)
            t[live] -= np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) * rate[live]
            reg = rows[live] * m + (_mix(u ^ _C3) % np.uint64(m)).astype(np.int64)
            arrive = t[live]
            np.minimum.at(best, reg, arrive)
            won = best[reg] == arrive
            sig[reg[won]] = h[live[won]]
            # the next arrival is later still: go on only below the row's latest register
            live = live[arrive < best.reshape(n_rows, m).max(axis=1)[rows[live]]]
    return sig.reshape(n_rows, m)


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end of each value) of an Arrow string column."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    a = a.cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off[:-1], off[1:]


def _blocks(starts: np.ndarray, ends: np.ndarray):
    """Ranges of rows of about SLAB bytes."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLAB, side="right")))
        yield i, j
        i = j


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.zeros((len(sig), bands), np.uint64)
        s = sig.reshape(len(sig), bands, rows)
        for r in range(rows):
            keys = _mix(keys * _C1 + s[:, :, r])
        return _mix(keys + np.arange(bands, dtype=np.uint64) * _C1).view(np.int64)


def _signatures(bands: int, band_rows: int, size: int):
    def run(batches):
        shingler = Shingler(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts, ends = _bytes_of(batch.column("text"))
            for i, j in _blocks(starts, ends):
                rows, h, w = _weighted(*shingler.hashes(data, starts[i:j], ends[i:j]))
                keys = _band_keys(probminhash(rows, h, w, j - i, bands * band_rows), bands, band_rows)
                has = np.zeros(j - i, bool)
                has[rows] = True
                flat = pa.array(keys.ravel(), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("key").slice(i, j - i), pa.array(has), lists], ["id", "key", "has", "keys"])

    return run


def _features(size: int):
    """Sorted distinct shingle hashes (32 bits each) with counts where any is over 1."""

    def run(batches):
        shingler = Shingler(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts, ends = _bytes_of(batch.column("text"))
            for i, j in _blocks(starts, ends):
                rows, h = shingler.hashes(data, starts[i:j], ends[i:j])
                rows, h, w = _weighted(rows, h >> np.uint64(32))
                cut = np.searchsorted(rows, np.arange(j - i + 1))
                hs = [h[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:])]
                ws = [w[a:b].astype("<u4").tobytes() if (w[a:b] > 1).any() else b"" for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(hs, pa.binary()), pa.array(ws, pa.binary())], ["id", "hs", "ws"])

    return run


def probability_jaccard(a, aw, b, bw) -> float:
    """J_P of two sorted arrays of distinct hashes with counts (None: all one)."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if aw is None and bw is None:
        return len(common) / (len(a) + len(b) - len(common))
    aw = np.ones(len(a)) if aw is None else aw.astype(float)
    bw = np.ones(len(b)) if bw is None else bw.astype(float)
    x, y = aw[i], bw[j]
    # sum_e max(a_e / a_d, b_e / b_d): elements in order of a_e / b_e; those above the ratio a_d / b_d take b's side
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    xs, ys, rs = x[order], y[order], ratio[order]
    only_a, only_b = aw.sum() - x.sum(), bw.sum() - y.sum()
    above_a = np.concatenate([np.cumsum(xs[::-1])[::-1], [0.0]])
    below_b = np.concatenate([[0.0], np.cumsum(ys)])
    at = np.searchsorted(rs, rs, side="left")
    return float((1 / ((above_a[at] + only_a) / xs + (below_b[at] + only_b) / ys)).sum())


def _tally(batches):
    """Counts of shingles by slot, over the rows of a task."""
    counts = np.zeros(SLOTS, np.int32)
    for batch in batches:
        for x in batch.column("hs"):
            counts[np.frombuffer(x.as_buffer(), "<u4") & np.uint32(SLOTS - 1)] += 1
    parts = counts.reshape(-1, SEGMENT)
    used = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["seg", "n"])


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SEGMENT, np.int32)
    for raw in pdf["n"]:
        total += np.frombuffer(raw, np.int32)
    return pd.DataFrame({"seg": [pdf["seg"].iloc[0]], "n": [total.tobytes()]})


def _prefix(shared, threshold: float):
    """The rarest shingles of each document whose weight is just over 1 - threshold of all; those of one document alone are left out."""

    def run(batches):
        counts = np.frombuffer(shared.value, np.int32)
        for batch in batches:
            ids, tokens = [], []
            for i, x, w in zip(batch.column("id"), batch.column("hs"), batch.column("ws")):
                h = np.frombuffer(x.as_buffer(), "<u4")
                if not len(h):
                    continue
                w = np.frombuffer(w.as_buffer(), "<u4").astype(float) if len(w.as_buffer()) else np.ones(len(h))
                n = counts[h & np.uint32(SLOTS - 1)]
                order = np.lexsort((h, n))
                upto = np.cumsum(w[order]) - w[order] <= (1 - threshold) * w.sum() + 1e-9
                take = order[upto & (n[order] > 1)]
                ids.append(np.full(len(take), i.as_py(), np.int64))
                tokens.append(h[take].astype(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(ids))], ["bucket", "id"])

    return run


def _rare_buckets(feats: DataFrame, threshold: float) -> DataFrame:
    """(bucket, id): documents by their rarest shingles, those that at least two share."""
    counts = np.zeros((SLOTS // SEGMENT, SEGMENT), np.int32)
    for r in feats.select("hs").mapInArrow(_tally, "seg int, n binary").groupBy("seg").applyInPandas(_summed, "seg int, n binary").toLocalIterator():
        counts[r["seg"]] = np.frombuffer(bytes(r["n"]), np.int32)
    shared = feats.sparkSession.sparkContext.broadcast(counts.tobytes())
    tokens = materialize(feats.mapInArrow(_prefix(shared, threshold), "bucket long, id long"), "tokens")
    many = tokens.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    return tokens.join(many, "bucket")


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            keep, sims = [], []
            for i, (ha, wa, hb, wb) in enumerate(zip(*(batch.column(c) for c in ("ha", "wa", "hb", "wb")))):
                a, b = (np.frombuffer(x.as_buffer(), "<u4") for x in (ha, hb))
                if min(len(a), len(b)) == 0:
                    continue
                aw, bw = (np.frombuffer(x.as_buffer(), "<u4") if len(x.as_buffer()) else None for x in (wa, wb))
                sim = probability_jaccard(a, aw, b, bw)
                if sim >= threshold:
                    keep.append(i)
                    sims.append(sim)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep, pa.int64())) for c in ("src", "dst")), pa.array(sims, pa.float64())], ["src", "dst", "sim"])

    return run


def _verified(pairs: DataFrame, n_pairs: int, feats: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, sim) of the pairs (src, dst) with J_P of at least ``threshold``.

    The number of tasks follows the pairs. A src of very many pairs is salted: its features go to several tasks.
    """
    tasks = min(MOST_TASKS, max(12, -(-n_pairs // PAIRS_PER_TASK)))
    limit = hot_limit(n_pairs)
    hot = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("src", F.ceil(F.col("n") / limit).alias("salts"))
    hot = materialize(hot, "hot")
    a = feats.select(F.col("id").alias("src"), F.col("hs").alias("ha"), F.col("ws").alias("wa")).join(F.broadcast(hot), "src", "left")
    a = a.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    b = feats.select(F.col("id").alias("dst"), F.col("hs").alias("hb"), F.col("ws").alias("wb"))
    on = pairs.select("src", "dst").repartition(tasks, "dst").join(b.repartition(tasks, "dst"), "dst").join(F.broadcast(hot), "src", "left")
    on = on.withColumn("salt", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1)))).drop("salts")
    both = on.repartition(tasks, "src", "salt").join(a.repartition(tasks, "src", "salt"), ["src", "salt"])
    return materialize(both.mapInArrow(_verify(threshold), "src long, dst long, sim double"), "links")


def _opened(members: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, int]:
    """(bucket, id, root, pivot, p_root) of the buckets whose members are of more than one class, and the number of rows."""
    if roots is None:
        placed = members.withColumn("root", F.col("id"))
    else:
        placed = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "root")).alias("p"), F.min("root").alias("a"), F.max("root").alias("b"))
    groups = materialize(groups.where("a < b").select("bucket", "n", F.col("p.id").alias("pivot"), F.col("p.root").alias("p_root")), "open")
    size = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    on = materialize(join_groups(placed, groups, "bucket", "n", size).select("bucket", "id", "root", "pivot", "p_root"), "buckets", size)
    release(groups)
    return on, size


def _rest_links(on: DataFrame, size: int, feats: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, sim) of links between the documents of buckets that stay open, found exactly.

    ``links``: what has been verified so far, which makes the stars. Documents that share a rare shingle are compared
    with the stars of large classes, then with those of their members that the metric lets through; buckets of a few
    documents of small classes are compared as pairs, larger ones block against block.
    """
    ids = on.select("id", "root").distinct()
    home = links.groupBy(F.col("dst").alias("id")).agg(F.max(F.struct("sim", "src")).alias("m")).select("id", F.col("m.src").alias("star"), (1 - F.col("m.sim")).alias("r"))
    places = ids.join(home, "id", "left").select("id", "root", F.coalesce("star", "id").alias("star"), F.coalesce("r", F.lit(0.0)).alias("r"))
    places = materialize(places, "places", size)
    rest = materialize(feats.join(places, "id"), "rest", size)
    sizes = places.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    tokens = materialize(_rare_buckets(rest.select("id", "hs", "ws"), threshold).join(places.join(sizes, "root").drop("r"), "id"), "tokens")

    # large classes and all that meet them: first the pivots of their stars, then the members that are far enough from those
    large = tokens.where(F.col("n") > BLOCK).select("bucket", F.col("root").alias("big"), F.col("n").alias("n_big"), "star").distinct()
    met = large.join(tokens.select("bucket", F.col("id").alias("dst"), "root", "n"), "bucket")
    met = met.where((F.col("big") != F.col("root")) & ((F.col("n_big") > F.col("n")) | ((F.col("n_big") == F.col("n")) & (F.col("big") < F.col("root")))))
    met = materialize(met.select(F.col("star").alias("src"), "dst").distinct(), "met", size)
    sims = _verified(met, met.count(), feats, 2 * threshold - 1 - 1e-9)
    found = [sims.where(F.col("sim") >= threshold)]
    probes = sims.where(F.col("sim") < threshold).groupBy("src", "dst").agg(F.max("sim").alias("sim")).select(F.col("src").alias("star"), F.col("dst").alias("id"), (threshold - F.col("sim") - 1e-9).alias("need"))
    probes = materialize(probes, "probes", size)
    least = probes.groupBy("star").agg(F.min("need").alias("least"), F.ceil(F.count(F.lit(1)) / PROBES).alias("slices"))
    held = rest.join(least, "star").where(F.col("r") >= F.col("least"))
    plan = held.groupBy("star").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.first("slices").alias("slices"))
    plan = materialize(plan, "plan", size)
    probes = probes.join(plan, "star").join(rest.select("id", "root", "hs", "ws"), "id")
    probes = probes.select("star", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.col("slices")).alias("slice"), "id", "root", "hs", "ws", "need")
    held = held.drop("slices").join(plan, "star").select(F.col("star").alias("h_star"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias("h_block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("h_slice"), F.col("id").alias("h_id"), F.col("root").alias("h_root"), F.col("hs").alias("h_hs"), F.col("ws").alias("h_ws"), F.col("r").alias("h_r"))
    found.append(probes.groupBy("star", "block", "slice").cogroup(held.groupBy("h_star", "h_block", "h_slice")).applyInPandas(_compare(threshold), "src long, dst long, sim double"))

    # buckets of small classes
    small = tokens.where(F.col("n") <= BLOCK).select("bucket", "id", "root")
    counts = small.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("bucket", "k")
    counts = materialize(counts, "counts")
    n_small = counts.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    small = materialize(join_groups(small, counts, "bucket", "k", n_small), "small")
    few = small.where(F.col("k") <= FEW)
    pairs = few.join(few.select("bucket", F.col("id").alias("dst"), F.col("root").alias("d_root")), "bucket").where("id < dst and root != d_root").select(F.col("id").alias("src"), "dst").distinct()
    pairs = materialize(pairs, "pairs", size * FEW)
    found.append(_verified(pairs, pairs.count(), feats, threshold))

    one = small.where((F.col("k") > FEW) & (F.col("k") <= WIDE)).select("bucket", "id").join(rest.select("id", "root", "hs", "ws"), "id")
    found.append(one.groupBy("bucket").applyInPandas(_compare_within(threshold), "src long, dst long, sim double"))
    many = small.where(F.col("k") > WIDE).withColumn("blocks", F.ceil(F.col("k") / WIDE)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    first = many.select("bucket", F.col("own").alias("bi"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("bj"), "id")
    second = many.select(F.col("bucket").alias("h_bucket"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("h_bi"), F.col("own").alias("h_bj"), F.col("id").alias("h_id"))
    first = first.join(rest.select("id", "root", "hs", "ws", F.lit(0.0).alias("need")), "id")
    second = second.join(rest.select(F.col("id").alias("h_id"), F.col("root").alias("h_root"), F.col("hs").alias("h_hs"), F.col("ws").alias("h_ws"), F.lit(1.0).alias("h_r")), "h_id")
    found.append(first.groupBy("bucket", "bi", "bj").cogroup(second.groupBy("h_bucket", "h_bi", "h_bj")).applyInPandas(_compare(threshold), "src long, dst long, sim double"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return materialize(out, "links")


def _compare_within(threshold: float):
    compare = _compare(threshold)

    def run(docs: pd.DataFrame) -> pd.DataFrame:
        names = {c: f"h_{c}" for c in ("id", "root", "hs", "ws")}
        return compare(docs.assign(need=0.0), docs.rename(columns=names).assign(h_r=1.0))

    return run


def _compare(threshold: float):
    def run(probes: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        sets = [np.frombuffer(x, "<u4") for x in held["h_hs"]]
        weights = [np.frombuffer(x, "<u4") if len(x) else None for x in held["h_ws"]]
        if sets and len(probes):
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            ids, classes, reach = held["h_id"].to_numpy(), held["h_root"].to_numpy(), held["h_r"].to_numpy()
            for i, root, x, w, need in zip(probes["id"], probes["root"], probes["hs"], probes["ws"], probes["need"]):
                h = np.frombuffer(x, "<u4")
                w = np.frombuffer(w, "<u4") if len(w) else None
                lo, hi = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                mass = np.ones(len(h)) if w is None else w.astype(float)
                common = np.bincount(owner[at], weights=np.repeat(mass, n), minlength=len(sets))
                done = set()
                # J_P is at most the common share of the document's weight
                for k in np.flatnonzero((common >= threshold * mass.sum() - 1e-6) & (classes != root) & (reach >= need)).tolist():
                    if classes[k] in done:
                        continue
                    sim = probability_jaccard(h, w, sets[k], weights[k])
                    if sim >= threshold:
                        found.append((int(i), int(ids[k]), sim))
                        done.add(classes[k])  # further links to the same class say no more
        return pd.DataFrame({"src": np.array([f[0] for f in found], np.int64), "dst": np.array([f[1] for f in found], np.int64), "sim": np.array([f[2] for f in found], float)})

    return run


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(id, root) after new links: their ends' roots are joined, and known vertices follow their roots."""
    n = links.count()
    if not n:
        return roots
    if roots is None:
        return materialize(star_forest(links.select("src", "dst"), rows=n).select(F.col("node").alias("id"), "root"), "roots", 2 * n)
    ends = links.join(roots.select(F.col("id").alias("src"), F.col("root").alias("rs")), "src", "left").join(roots.select(F.col("id").alias("dst"), F.col("root").alias("rd")), "dst", "left")
    ends = materialize(ends.select(F.coalesce("rs", "src").alias("src"), F.coalesce("rd", "dst").alias("dst")), "links", n)
    moved = materialize(star_forest(ends, rows=n).select("node", F.col("root").alias("to")), "moved", 2 * n)
    old = roots.join(moved, F.col("root") == F.col("node"), "left").select("id", F.coalesce("to", "root").alias("root"))
    new = moved.join(roots.select("id"), F.col("node") == F.col("id"), "left_anti").select(F.col("node").alias("id"), F.col("to").alias("root"))
    return materialize(old.unionByName(new), "roots", roots.count() + 2 * n)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, bands: int = BANDS, band_rows: int = ROWS, pivot_rounds: int = 2) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), class_size, kept (the row is that id's), class_links.

    ``class_links`` counts the links between different texts that were verified to make the class; that is at least
    enough to connect it, and not every link there is. Null counts as empty text; texts without words are equal to one
    another only. Rows with a null id are kept, in no class (class_id null, size 1). An id that occurs with several
    texts puts them in one class; equal rows all stay rows. Whole texts are read, of any length. Other columns are not
    looked at, so their names do not matter. An empty table gives no rows.
    """
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "500")  # long documents: bounds a batch's bytes; every task in Python has run on return
    try:
        return _near_groups(df, id_col, text_col, threshold, shingle, bands, band_rows, pivot_rounds)
    finally:
        spark.conf.set(setting, before)


def _near_groups(df: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int, bands: int, band_rows: int, pivot_rounds: int) -> DataFrame:
    docs = df.select(column(id_col).cast("long").alias("id"), F.lower(F.coalesce(column(text_col), F.lit(""))).alias("text"))
    scanned = docs.where("id is not null").select("id", F.md5("text").alias("key"), "text")
    rows = materialize(scanned.mapInArrow(_signatures(bands, band_rows, shingle), "id long, key string, has boolean, keys array<long>"), "signatures")
    total = rows.count()
    nodes = materialize(rows.groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "nodes", total)

    heads = rows.where("has").join(nodes.select(F.col("key").alias("_key"), "node"), (F.col("key") == F.col("_key")) & (F.col("id") == F.col("node"))).dropDuplicates(["key"])
    members = materialize(heads.select("id", "key", F.explode("keys").alias("bucket")), "members")
    on, size = _opened(members.select("bucket", "id"), None)

    # features of each head in an open bucket, once a text: an id may be the head of several
    wanted = members.join(on.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct()
    texts = scanned.join(wanted, (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi").dropDuplicates(["id", "key"])
    feats = materialize(texts.select("id", "text").mapInArrow(_features(shingle), "id long, hs binary, ws binary"), "features")
    release(members)

    roots, links = None, feats.sparkSession.createDataFrame([], "src long, dst long, sim double")
    several = rows.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("id")
    of_one_id = rows.join(several, "id").join(nodes.select("key", "node"), "key").groupBy("id").agg(F.collect_set("node").alias("nodes"))
    ties = of_one_id.select(F.array_min("nodes").alias("src"), F.explode("nodes").alias("dst")).where("src != dst").distinct()
    roots = _joined(roots, materialize(ties, "ties"))
    for _ in range(pivot_rounds):
        if not size:
            break
        pairs = materialize(on.where("id != pivot and root != p_root").select(F.col("pivot").alias("src"), F.col("id").alias("dst")).distinct(), "pairs", size)
        n_pairs = pairs.count()
        if n_pairs:
            new = _verified(pairs, n_pairs, feats, threshold)
            roots, links = _joined(roots, new), links.unionByName(new)
        left, last = on.where("id != pivot").select("bucket", "id"), on
        on, size = _opened(left, roots)
        release(pairs, last)
    if size:
        new = _rest_links(on, size, feats, links, threshold)
        roots, links = _joined(roots, new), links.unionByName(new)

    label = nodes.select("key", "node", "n")
    if roots is not None:
        counted = links.select("src", "dst").distinct().join(roots, F.col("src") == F.col("id")).groupBy(F.col("root").alias("l_root")).agg(F.count(F.lit(1)).alias("class_links"))
        label = label.join(roots, F.col("node") == F.col("id"), "left").select("key", F.coalesce("root", "node").alias("class_id"), "n")
        label = label.join(counted, F.col("class_id") == F.col("l_root"), "left").select("key", "class_id", "n", F.coalesce("class_links", F.lit(0).cast("long")).alias("class_links"))
    else:
        label = label.select("key", F.col("node").alias("class_id"), "n", F.lit(0).cast("long").alias("class_links"))
    label = materialize(label, "classes")
    sizes = label.groupBy("class_id").agg(F.sum("n").alias("class_size"))
    label = materialize(label.join(sizes, "class_id"), "labels")
    out = join_groups(rows.select("id", "key"), label, "key", "n", total)
    out = out.select(F.col("id").alias("doc_id"), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept"), "class_links")
    none = docs.where("id is null").select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("class_links"))
    return out.unionByName(none)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one document of each class: the row of its smallest id; rows with a null id stay.

    Rows that share an id stay or go together. Columns keep their names, whatever they are.
    """
    gone_col, = free(df, "_gone")
    gone = near_groups(df, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias(gone_col))
    return df.join(gone, column(id_col) == F.col(gone_col), "left_anti")
