"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity``; full pieces are sequences by themselves. The rest is dealt into
partitions of bounded size, packed best-fit decreasing in each, and compared with lower bounds from dual-feasible
functions. A partition whose bin count equals its bound is certified and done. The others release their emptiest
bins; the released pieces of several partitions meet in one and are packed best-fit decreasing again, until every
count is certified or one partition is left. A repacking that needs more bins than it was given is not taken.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kinsplit.plans.names import column
from kinsplit.plans.storage import materialize

PART_ROWS = 40_000  # pieces a partition
FAN_IN = 8  # partitions whose released pieces meet
RELEASED = 0.2  # most of a partition's bins that it releases
CACHE = 50_000  # words whose ids a task remembers
TEXT_BYTES = 4 << 20  # of texts whose words are looked up together, about


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each size, and the number of bins. Bins by room left, with a bit mask of rooms in use."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        m = mask >> s
        if m:
            room = s + (m & -m).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if room > s:
            stacks[room - s].append(b)
            mask |= 1 << (room - s)
    return bins, offsets, n


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that pieces of these sizes need at least."""
    return lower_bound_of_counts(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity)


def lower_bound_of_counts(hist: np.ndarray, capacity: int) -> int:
    """The best of the volume bound, the thresholds' bound (large pieces alone, middle ones by volume) and rounding dual-feasible functions.

    ``hist``: pieces by size, 0 to ``capacity``.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    count, volume = np.concatenate([[0], np.cumsum(hist)]), np.concatenate([[0], np.cumsum(hist * x)])
    best = -(-int(volume[-1]) // capacity)
    half = capacity // 2
    for a in range(0, half + 1):
        large = count[-1] - count[capacity - a + 1]
        mid = count[capacity - a + 1] - count[half + 1]
        vol = (volume[half + 1] - volume[a]) - (mid * capacity - (volume[capacity - a + 1] - volume[half + 1]))
        best = max(best, int(large + mid + max(0, -(-int(vol) // capacity))))
    for k in range(1, 64):
        scaled = (k + 1) * x
        u = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((hist * u).sum()) // (k * capacity)))
    return best


# ---- tokens

_ODD = re.compile(r"[^\x00-ɏ]|<\|endoftext\|>")
_RUN = re.compile(r"\s ")
# the same for Arrow, whose \s is of ASCII alone
_ODD_RE2, _RUN_RE2 = r"[^\x00-\x{24f}]|<\|endoftext\|>", r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}] "


class _Ids:
    """Little-endian ids of texts, the same as the tokenizer's. Words are looked up in a bounded memory.

    A space before a word always starts a token here, so texts whose spaces follow no other white space can be cut
    at them and each word encoded once. Texts with characters whose class may depend on a Unicode version, or with
    the tokenizer's control string, go to the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None):
        self.path = tokenizer_path
        self.known: dict[str, bytes] = {}
        self.plain = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.widths = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each id
            self.widths[list(ranks.values())] = [len(b) for b in ranks]

    @cached_property
    def tokenizer(self):
        """Held from the first text on that needs it, as most tasks have none."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def of(self, text: str) -> bytes:
        if self.plain is None or _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _RUN.search(text):
            return np.array(self.plain.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        known, out = self.known, [self._word(first)]
        for w in rest:
            b = known.get(w)
            if b is None:
                b = self._word(" " + w)
                if len(known) < CACHE:
                    known[w] = b
            out.append(b)
        return b"".join(out)

    def _word(self, w: str) -> bytes:
        return np.array(self.plain.encode_ordinary(w), "<u4").tobytes()

    def of_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text in turn (null: none). Texts are taken by some bytes together, and their words once each."""
        at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // TEXT_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            yield from self._of_some(pc.fill_null(texts.slice(a, b - a), ""))

    def _of_some(self, texts: pa.Array) -> Iterator[bytes]:
        if self.plain is None:
            yield from (self.of(x.as_py()) for x in texts)
            return
        # texts that can be cut at their spaces
        cut = pc.invert(pc.or_(pc.match_substring_regex(texts, _ODD_RE2), pc.match_substring_regex(texts, _RUN_RE2)))
        split = pc.split_pattern(texts.filter(cut), " ")
        bounds, words = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())]).astype(np.int64), split.flatten()
        coded, firsts = words.dictionary_encode(), bounds[:-1]
        ids = self._spaced(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy().astype(np.int64)
        index[firsts] = len(ids) + np.arange(len(firsts))  # no space stands before these
        ids += map(self._word, words.take(pa.array(firsts)).to_pylist())
        joined = pa.array(ids, pa.large_binary()).take(pa.array(index))
        ends, data = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :][: len(joined) + 1], memoryview(joined.buffers()[2] or b"")
        spans = zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist())
        for text, met in zip(texts, cut.to_pylist()):
            if met:
                start, end = next(spans)
                yield bytes(data[start:end])
            else:
                yield self.of(text.as_py())

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it. What is not known is encoded as one text and cut where words end."""
        out = list(map(self.known.get, words))
        new = [i for i, b in enumerate(out) if b is None]
        alone = [i for i in new if not words[i] or words[i][-1].isspace()]  # the next one's space would follow white space
        for i in alone:
            out[i] = self._word(" " + words[i])
        together = [i for i in new if out[i] is None]
        if together:
            ids = np.array(self.plain.encode_ordinary(" " + " ".join([words[i] for i in together])), "<u4")
            ends = np.cumsum([len(words[i].encode()) + 1 for i in together])
            reached = np.cumsum(self.widths[ids])
            cuts = np.searchsorted(reached, ends)
            if np.array_equal(reached[cuts], ends):
                raw, start = ids.tobytes(), 0
                for i, end in zip(together, (4 * (cuts + 1)).tolist()):
                    out[i], start = raw[start:end], end
            else:  # no token should go over the end of a word
                for i in together:
                    out[i] = self._word(" " + words[i])
        for i in new[: max(0, CACHE - len(self.known))]:
            self.known[words[i]] = out[i]
        return out


def token_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer_path: str, ranks_path: str | None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every whole text (null: empty)."""

    def run(batches):
        ids = _Ids(tokenizer_path, ranks_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, pieces, starts, lengths, crcs = [], [], [], [], []
            for row, raw in enumerate(ids.of_all(batch.column("text"))):
                raw += end
                n = len(raw) // 4
                first = n % capacity or capacity
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    length = first if piece == 0 else capacity
                    at.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(raw[4 * start : 4 * (start + length)]))
            # ids stay Arrow values: next to a null, pandas would make floats of them
            doc_id = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(pieces, pa.int32()), *(pa.array(c, pa.int64()) for c in (starts, lengths, crcs))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- packing

_COLUMNS = "row long, length long, bin long, offset long, open boolean"


def _packer(capacity: int, round_no: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(sizes, capacity)
        had = pdf["bin"].nunique() if round_no else n + 1
        base = (round_no << 56) | (int(key[0]) << 28)
        out = pdf[["row", "length", "bin", "offset"]].copy()
        if n <= had:
            out["bin"], out["offset"] = base + bins, offsets
        n = min(n, had)
        gap = n - lower_bound(sizes, capacity)
        out["open"] = False
        if gap > 0:
            fill = out.groupby("bin")["length"].sum().sort_values(kind="stable")
            free = fill.index[: min(max(4 * gap, 16), max(1, int(n * RELEASED)))]
            out["open"] = out["bin"].isin(free)
        return out

    return run


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (row long, length long) with bin and offset; a table written to the shared folder."""
    n = pieces.count()
    groups = max(1, -(-n // PART_ROWS))
    todo = pieces.select("row", "length", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"))
    done, k = None, -1
    while True:
        k += 1
        key = F.pmod(F.xxhash64("row"), F.lit(groups)) if k == 0 else F.pmod(F.shiftright(F.col("bin").bitwiseAND(F.lit((1 << 56) - 1)), 28), F.lit(groups))
        made = todo.withColumn("g", key.cast("int")).groupBy("g").applyInPandas(_packer(capacity, k), _COLUMNS)
        made = materialize(made, "packed")
        last = groups == 1 or made.where("open").isEmpty()
        sealed = (made if last else made.where("not open")).drop("open")
        done = sealed if done is None else done.unionByName(sealed)
        if last:
            return done
        todo, groups = made.where("open").drop("open"), -(-groups // FAN_IN)


def pack_documents(df: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, n_sequences, least_sequences.

    A document's ids end with id 0; an empty or null text is that id alone. Only documents longer than ``capacity``
    are cut, and their first piece may be shorter; texts are read whole, of any length. Rows with equal or null ids are
    packed one by one like others, and ids of any size stay exact. Other columns are not looked at, whatever their
    names. An empty table gives no rows. ``n_sequences`` is how many sequences were made of all pieces, and
    ``least_sequences`` the certified bound that none can do with fewer of.
    """
    pieces = token_pieces(df, id_col, text_col, capacity, tokenizer_path, ranks_path)
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    packed = pack(pieces.where(F.col("length") < capacity).select("row", "length"), capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a length, capacity at most
        counts[r["length"]] = r["n"]
    full = int(counts[capacity])
    counts[capacity] = 0
    made, least = packed.select("bin").distinct().count() + full, lower_bound_of_counts(counts, capacity) + full
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    some = pieces.where(F.col("length") < capacity).join(packed.select("row", F.col("bin").alias("sequence_id"), "offset"), "row")
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -F.col("row") - 1).withColumn("offset", F.lit(0).cast("long"))
    out = some.select(*cols).unionByName(whole.select(*cols))
    return out.withColumn("n_sequences", F.lit(made).cast("long")).withColumn("least_sequences", F.lit(least).cast("long"))
