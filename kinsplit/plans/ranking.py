"""Numbers of rows in a global order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinsplit.plans.names import free, quote
from kinsplit.plans.storage import materialize

_ROW_BITS = 33  # monotonically_increasing_id is the partition's number above the row's


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with a long column ``name``: 0, 1, ... in the given order, which must leave no ties.

    The sort is a range exchange. Its partitions are written as they are; a row's number is its place in its partition
    plus the rows of the partitions before. One count a partition comes to the driver.
    """
    at, = free(df, "_at")
    placed = materialize(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(F.col(at), _ROW_BITS).cast("int")
    counts = sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    part_col, base = free(placed, "_part", "_base")
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], f"{part_col} int, {base} long")
    on = placed.withColumn(part_col, part).join(F.broadcast(offsets), part_col)
    return on.withColumn(name, F.col(base) + F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).select(*[quote(c) for c in df.columns], name)
