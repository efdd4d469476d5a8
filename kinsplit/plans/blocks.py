"""Block plans for exact all-pairs work: contiguous blocks by size, and which blocks can hold near pairs."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinsplit.plans.storage import materialize

MOST_CUTS = 4_000
PACK_BYTES = 2 << 20  # of the rows that a packed row holds, about
MOST_FILES = 96
MOST_ROWS = 20_000  # of blocks that grow with the table


def by_size(items: DataFrame, size, rows_per_block: int, most_blocks: int | None = None, most_rows: int = MOST_ROWS, most_size: float | None = None) -> tuple[DataFrame, list[tuple[float, float]]]:
    """``items`` (id, item, ...) with ``block``, and the (least, greatest) size of each block, in order of size.

    Items are copied once a pair of blocks. With ``most_blocks``, blocks hold more rows where there would be more of
    them, up to ``most_rows``, so that copies grow in proportion to the table; with ``most_size``, fewer rows where their sizes
    would sum to about more. Cuts are quantiles of the size; a range with too many rows of alike sizes is split further by hash of the id. Only
    a row per block comes to the driver.
    """
    sized = materialize(items.withColumn("size", size), "sized")  # else sizes are computed again for each cut
    n = sized.count()
    if most_blocks:
        rows_per_block = max(rows_per_block, min(most_rows, -(-n // most_blocks)))
    k = max(1, min(MOST_CUTS, -(-n // rows_per_block)))
    cuts = sorted(set(sized.approxQuantile("size", [i / k for i in range(1, k)], 0.25 / k))) if k > 1 else []
    placed = sized.withColumn("range", F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("size"))) if cuts else F.lit(0))
    stats = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sum"), F.min("size").alias("lo"), F.max("size").alias("hi")).orderBy("range").collect()
    spans, rows, base = [], [], 0
    for r in stats:
        parts = max(-(-r["n"] // rows_per_block), math.ceil(r["sum"] / most_size) if most_size else 1)
        rows.append((r["range"], base, parts))
        spans += [(r["lo"], r["hi"])] * parts
        base += parts
    spark = items.sparkSession
    table = spark.createDataFrame(rows or [(0, 0, 1)], "range int, base int, parts int")
    out = placed.join(F.broadcast(table), "range").withColumn("block", (F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    return out.select(*items.columns, "block"), spans


def packed(placed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, data): the rows of each block as Arrow streams of bounded size, as a table.

    What is dealt to many pairs of blocks is then copied as bytes, not item by item.
    """
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = max(1, b.num_rows * PACK_BYTES // max(1, b.nbytes))
            for s in range(0, b.num_rows, rows):
                part, sink = b.slice(s, rows), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "data"])

    rows = placed.groupBy("block").applyInArrow(run, "block int, data binary")
    return materialize(rows.repartition(max(1, min(MOST_FILES, n_blocks)), F.xxhash64("data")), "packed")


def unpacked(data: Iterable[pa.Scalar]) -> pa.Table | None:
    """The rows of packed ones; None without any."""
    tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in data]
    return pa.concat_tables(tables) if tables else None


def partners(spans: list[tuple[float, float]], near) -> list[tuple[int, int, int]]:
    """(block, first, last): the contiguous partners before and after each block that near(small, large) lets through."""
    n = len(spans)
    first = list(range(n))
    lo = 0
    for j in range(n):
        while lo < j and not (spans[lo][1] >= spans[j][0] or near(spans[lo][1], spans[j][0])):
            lo += 1
        first[j] = lo
    last = list(range(n))
    for j in range(n):
        last[first[j]] = max(last[first[j]], j)
    for i in range(1, n):
        last[i] = max(last[i], last[i - 1])
    return [(i, first[i], last[i]) for i in range(n)]


def block_pairs(items: DataFrame, spans: list[tuple[float, float]], near) -> DataFrame:
    """(bi, bj, side, ...): each row of ``items`` (block, ...) once for every pair of blocks bi <= bj that it takes part in."""
    spark = items.sparkSession
    table = spark.createDataFrame(partners(spans, near) or [(0, 0, 0)], "block int, first int, last int")
    on, own = items.join(F.broadcast(table), "block"), [c for c in items.columns if c != "block"]
    upper = on.select(F.explode(F.sequence("first", "block")).alias("bi"), F.col("block").alias("bj"), F.lit(1).alias("side"), *own)
    lower = on.where("last > block").select(F.col("block").alias("bi"), F.explode(F.sequence(F.col("block") + 1, F.col("last"))).alias("bj"), F.lit(0).alias("side"), *own)
    return upper.unionByName(lower)
