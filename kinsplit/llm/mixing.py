"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Targets are words a source. Among all document rates r with sum(r * size) = target in each source, those of least
relative entropy to rate one are r = exp(lambda * size / mean size), here also held at ``max_copies``. The convex dual
has one multiplier a source; Newton steps, safeguarded by a bracket, solve all of them together. One step is one
aggregation over cells (source, size, count), which is what all rates depend on.

Rates become whole copies by systematic rounding over the cells of a source in order of size, so rounding errors of
neighbours cancel; a cell with many documents is cut by hash of id and text into slices of about SLICE, whose quotas come
from the same running sum: over a source's cells (as many as it has different sizes), then over a cell's slices. What a
few very long documents leave over is then made up by copies of shorter ones, longest first, and a last step per source
adds or drops the one copy that brings the words nearest the target. Nothing is random; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from kinsplit.plans.names import column, columns, free
from kinsplit.plans.storage import materialize, release

SLICE = 1_000  # documents a slice of a cell; rows equal in id and text stay in one
NEWTON_STEPS = 500
TOLERANCE, CLOSED = 1e-9, 1e-13  # of a target; of a bracket


def word_count(text):
    """Runs of characters other than space and the controls 9 to 13; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """``sources`` (source, source_size) with its target.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all sizes; a target stops at
    max_copies times its source's size and the excess is shared among the others by weight, until none is above.
    That fixed point is min(cap, weight * level): sorted by cap / weight, running sums give the level.
    The windows run over one row a source.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    s = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", F.lit(float(max_copies)) * F.col("source_size"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(every)).withColumn("_all", F.sum("_w").over(every))
    by_ratio = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, upto, whole = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(W.unboundedPreceding, W.currentRow), by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_ws", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_level", (F.col("_total") - F.col("_caps")) / (F.col("_all") - F.col("_ws")))
    s = s.withColumn("_full", F.min(F.col("_level") * F.col("_w") >= F.col("_cap")).over(upto))
    level = F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(whole)
    return s.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * level)).select(*sources.columns, "target")


def _rate(lam, z, cap):
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * z, F.lit(50.0))))


def multipliers(cells: DataFrame, targets: DataFrame, max_copies: int = 2) -> DataFrame:
    """(source, lam, mean): the dual's solution. ``cells`` has source, size, n; sizes of 0 do not count.

    A source is done when its words are within TOLERANCE of the target, or its bracket has closed to what doubles tell
    apart. Should that not come about, it is an error, never an unfinished answer.
    """
    cells = cells.where("size > 0")
    means = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    s = targets.join(means, targets["source"].eqNullSafe(means["source"])).select(targets["source"], "target", "source_size", "mean", "least")
    top = F.col("mean") / F.col("least") * 1.01  # from here every rate is at its cap
    state = s.select("source", "target", "mean", F.lit(-10000.0).alias("lo"), top.alias("hi"), F.when(F.col("target") >= max_copies * F.col("source_size"), top).otherwise(F.lit(0.0)).alias("lam"), (F.col("target") >= max_copies * F.col("source_size")).alias("done"))
    state = materialize(state, "dual")
    for _ in range(NEWTON_STEPS):
        z = F.col("size") / F.col("mean")
        words = F.col("size") * F.col("n")
        rate = _rate(F.col("lam"), z, max_copies)
        on = cells.join(state.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        slope = F.when(rate < max_copies, words * rate * z).otherwise(F.lit(0.0))
        sums = on.groupBy("_s", "target", "mean", "lo", "hi", "lam", "done").agg((F.sum(words * rate) - F.first("target")).alias("g"), F.sum(slope).alias("h"))
        low = F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("lo"))
        high = F.when(F.col("g") >= 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.col("g") / F.col("h")
        inside = (F.col("h") > 0) & (step > low) & (step < high)
        closed = high - low <= CLOSED * F.greatest(F.abs("lam"), F.lit(1.0))
        nxt = sums.withColumn("done", F.col("done") | (F.abs("g") <= TOLERANCE * F.col("target")) | closed)
        nxt = nxt.select(F.col("_s").alias("source"), "target", "mean", low.alias("lo"), high.alias("hi"), F.when(F.col("done"), F.col("lam")).when(inside, step).otherwise((low + high) / 2).alias("lam"), "done")
        nxt = materialize(nxt, "dual")
        release(state)
        state = nxt
        if state.where("not done").isEmpty():
            return state.select("source", "lam", "mean")
    raise RuntimeError(f"the dual of {state.where('not done').count()} sources was not solved in {NEWTON_STEPS} steps")


def mix(df: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, max_copies: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken (= copies * size).

    Null text has size 0; null source is a source of its own, last. Documents of size 0 are taken no times and an
    empty table gives no rows. Rows with equal or null ids are rows of their own; equal rows may get unequal copies.
    Whole texts are counted, of any length. Other columns are not looked at, whatever their names. RuntimeError if the
    dual is not solved.
    """
    text = column(text_col)
    cols = [column(id_col).alias("doc_id"), column(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(column(id_col), text).alias("h")]
    docs = materialize(df.select(*cols), "sizes")
    cells = materialize(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, max_copies)
    targets = materialize(targets, "targets")
    lam = multipliers(cells, targets, max_copies).withColumnRenamed("source", "_s")

    # rates and running sums by cell
    rated = cells.join(lam, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("lam"), F.col("size") / F.col("mean"), max_copies)).otherwise(F.lit(0.0)))
    part = F.col("rate") - F.floor("rate")
    cells_before = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    rated = rated.withColumn("before", F.coalesce(F.sum(part * F.col("n")).over(cells_before), F.lit(0.0)))
    rated = materialize(rated.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "rate", "before", F.ceil(F.col("n") / SLICE).alias("slices")), "rated")
    placed = docs.join(rated, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")))
    placed = materialize(placed.select("doc_id", "source", "size", "h", "rate", "before", F.pmod("h", F.col("slices")).alias("slice")), "placed")

    # quotas by slice: those of a cell differ by whole documents, so their sums meet exactly
    slices = placed.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n"), F.first("rate").alias("rate"), F.first("before").alias("before"))
    upto = F.sum("n").over(W.partitionBy("source", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow))
    slices = slices.withColumn("_n", upto).withColumn("quota", F.floor(F.col("before") + part * F.col("_n") + 0.5) - F.floor(F.col("before") + part * (F.col("_n") - F.col("n")) + 0.5))
    slices = slices.select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), F.col("slice").alias("q_slice"), "quota")
    rank = F.row_number().over(W.partitionBy("source", "size", "slice").orderBy("h", "doc_id"))
    ranked = placed.withColumn("place", rank).join(slices, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size")) & (F.col("slice") == F.col("q_slice")))
    copies = F.floor("rate") + F.when(F.col("place") <= F.col("quota"), 1).otherwise(0)
    ranked = materialize(ranked.select("doc_id", "source", "size", copies.cast("int").alias("copies"), "slice", "place"), "copies")

    ranked = materialize(_made_up(_beside_targets(ranked, targets), max_copies), "copies")

    # one copy more or less, of one row, where that brings a source nearer its target
    held = _beside_targets(ranked, targets)
    can = _movable(max_copies)
    after = F.abs(F.abs("off") - F.col("size"))
    best = held.where(can & (after < F.abs("off"))).groupBy("t_source").agg(F.min(F.struct(after, F.col("doc_id"), F.col("size"), F.col("slice"), F.col("place"))).alias("_b"), F.first(F.signum("off").cast("int")).alias("_d"))
    best = best.select(F.col("t_source").alias("b_source"), F.col("_b.size").alias("b_size"), F.col("_b.slice").alias("b_slice"), F.col("_b.place").alias("b_place"), "_d")
    final = held.join(best, F.col("source").eqNullSafe(F.col("b_source")), "left")
    chosen = (F.col("size") == F.col("b_size")) & (F.col("slice") == F.col("b_slice")) & (F.col("place") == F.col("b_place"))
    moved = F.when(chosen, F.col("copies") + F.col("_d")).otherwise(F.col("copies"))
    return final.select("doc_id", "size", "source_size", "target", moved.cast("int").alias("copies"), (moved * F.col("size")).cast("long").alias("taken"))


def _beside_targets(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """``ranked`` with t_source, target, source_size and ``off``, the words that its source still lacks."""
    off = ranked.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("_got"))
    off = off.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).select("t_source", "target", "source_size", (F.col("target") - F.col("_got")).alias("off"))
    return ranked.join(materialize(off, "off"), F.col("source").eqNullSafe(F.col("t_source")))


def _movable(max_copies: int):
    return F.when(F.col("off") > 0, F.col("copies") < max_copies).otherwise(F.col("copies") > 0) & (F.col("size") > 0)


def _made_up(held: DataFrame, max_copies: int) -> DataFrame:
    """``held`` with one copy more or less of as many documents as make up for ``off``, longest first, none longer than it."""
    can = held.where(_movable(max_copies) & (F.col("size") <= F.abs("off")))
    cells = can.groupBy("t_source", "size").agg(F.count(F.lit(1)).alias("m"), F.first(F.abs("off")).alias("off"))
    longer = F.coalesce(F.sum(F.col("m") * F.col("size")).over(W.partitionBy("t_source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("take", F.least(F.col("m"), F.floor((F.col("off") - longer) / F.col("size")))).where("take > 0")
    cells = cells.select(F.col("t_source").alias("c_source"), F.col("size").alias("c_size"), "take")
    slices = can.join(cells, F.col("t_source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))).groupBy("c_source", "c_size", "take", F.col("slice").alias("c_slice")).agg(F.count(F.lit(1)).alias("m"), F.collect_list("place").alias("places"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("c_source", "c_size").orderBy("c_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slices = slices.withColumn("take", F.least(F.col("m"), F.col("take") - before).cast("int")).where("take > 0")
    rows = slices.select("c_source", "c_size", "c_slice", F.explode(F.slice(F.sort_array("places"), F.lit(1), F.col("take"))).alias("c_place"))
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("slice") == F.col("c_slice")) & (F.col("place") == F.col("c_place"))
    moved = held.join(rows, same, "left").withColumn("copies", F.when(F.col("c_place").isNotNull(), F.col("copies") + F.signum("off")).otherwise(F.col("copies")).cast("int"))
    return moved.select("doc_id", "source", "size", "copies", "slice", "place")


def take_copies(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``df`` with each row as often as the mix takes it (0, 1 or 2 times); columns as they were, whatever their names.

    Copies belong to ids here: rows that share an id are taken as often as the one of them with the most copies, and
    rows with a null id stay once.
    """
    of, n, copy = free(df, "_id", "_copies", "_copy")
    copies = mix(df, id_col=id_col, **options).where("doc_id is not null").groupBy(F.col("doc_id").alias(of)).agg(F.max("copies").alias(n))
    on = df.join(copies, column(id_col) == F.col(of), "left")
    times = F.when(column(id_col).isNull(), 1).otherwise(F.col(n))
    return on.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(*columns(df))
