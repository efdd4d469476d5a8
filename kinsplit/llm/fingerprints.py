"""Document fingerprints: a canonical exact digest, in DataFrame and SQL functions alone.

Canonical form: compatibility composition (NFKC), full case folding, composition again, runs of white space to one
space, trimmed. Its fingerprint is a wide hash: two chained xxHash64 values with different seeds, 32 hexadecimal
digits. Equal hashes are then compared byte by byte within their bucket: where a bucket holds different canonical
texts, each gets its place among them as a suffix, so that equal fingerprints mean equal canonical texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinsplit.plans.names import column
from kinsplit.plans.storage import materialize

BUCKET_ROWS = 4_000  # rows of a slice of the id order
MOST = 1_000  # cuts of one level; two levels make up to MOST * MOST slices


def canonical(text: Column) -> Column:
    """The canonical form of ``text``; null counts as empty."""

    def composed(c: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), r"(?U)[\s\p{Z}]+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits of xxHash64 as text."""
    return F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), canon)), 16, "0"))


def collisions(texts: DataFrame) -> DataFrame:
    """(hash, canon, place) of the buckets of ``texts`` (hash, canon) that hold different bytes; usually no rows.

    A bucket's least and greatest text are gathered by partial aggregation, so copies never meet in one task.
    """
    ends = texts.groupBy("hash").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select(F.col("hash").alias("_h"))
    bad = materialize(ends, "collisions")
    if bad.isEmpty():
        return texts.sparkSession.createDataFrame([], "hash string, canon string, place int")
    apart = texts.join(bad, F.col("hash") == F.col("_h")).select("hash", "canon").distinct()
    return apart.select("hash", "canon", F.row_number().over(W.partitionBy("hash").orderBy("canon")).alias("place"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """doc_id, fingerprint, group_size of every row; null text counts as empty.

    Rows with equal canonical texts have equal fingerprints, others different ones. Rows with equal or null ids are
    rows of their own, and texts may be of any length. Other columns are not looked at, whatever their names. An empty
    table gives no rows. ``hashed`` can be a weaker hash, for tests of the comparison.
    """
    canon = canonical(column(text_col))
    texts = df.select(column(id_col).alias("doc_id"), hashed(canon).alias("hash"), canon.alias("canon"))
    narrow = materialize(texts.select("doc_id", "hash"), "fingerprints")
    sizes = narrow.groupBy("hash").agg(F.count(F.lit(1)).alias("group_size"))
    many = sizes.where("group_size > 1").select(F.col("hash").alias("_h"))
    apart = collisions(texts.join(many, F.col("hash") == F.col("_h"), "left_semi").select("hash", "canon"))
    if apart.isEmpty():
        return narrow.join(sizes, "hash").select("doc_id", F.col("hash").alias("fingerprint"), "group_size")
    placed = _suffixed(texts, apart).select("doc_id", "fingerprint")
    return placed.join(placed.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("group_size")), "fingerprint")


def _suffixed(texts: DataFrame, apart: DataFrame) -> DataFrame:
    p = apart.select(F.col("hash").alias("_h"), F.col("canon").alias("_c"), "place")
    on = texts.join(p, (F.col("hash") == F.col("_h")) & (F.col("canon") == F.col("_c")), "left")
    return on.withColumn("fingerprint", F.when(F.col("place").isNull(), F.col("hash")).otherwise(F.concat_ws("-", "hash", "place"))).drop("_h", "_c", "place")


# ---- each text next to its neighbour in id order


def _cuts(ids: DataFrame, k: int) -> list[int]:
    """At most k - 1 ids that occur, which part ``ids`` (doc_id) into slices of alike sizes."""
    if k <= 1:
        return []
    cuts = {int(c) for c in ids.where("doc_id is not null").approxQuantile("doc_id", [i / k for i in range(1, k)], 0.2 / k)}
    # quantiles are doubles, which may miss large ids
    return sorted(r[0] for r in ids.where(F.col("doc_id").isin(sorted(cuts))).distinct().collect()) if cuts else []


def _sliced(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``rows`` with ``slice`` (0, 1, ... in order of doc_id, null first) and ``starts`` (the id begins a later slice), and the number of the last slice.

    Up to MOST slices are cut at quantiles. Where more are wanted, each of those is cut again at its own quantiles,
    found by an aggregation; their starts are a table of at most MOST rows of MOST ids, which is broadcast.
    """
    k = max(1, -(-n // BUCKET_ROWS))
    ids = rows.select("doc_id")
    cuts = _cuts(ids, min(k, MOST))
    coarse = _search("doc_id", cuts)
    if k <= MOST:
        starts = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
        return rows.withColumn("slice", coarse.cast("long")).withColumn("starts", starts), len(cuts)
    m = min(MOST, -(-k // (len(cuts) + 1)))
    ids = ids.withColumn("coarse", coarse)
    fine = ids.groupBy("coarse").agg(F.percentile_approx("doc_id", [i / m for i in range(1, m + 1)], 10 * m).alias("fine"))
    sub = F.size(F.filter(F.coalesce("fine", F.array().cast("array<bigint>")), lambda c: c <= F.col("doc_id")))
    firsts = ids.join(F.broadcast(materialize(fine, "cuts")), "coarse").groupBy("coarse", sub.alias("sub")).agg(F.min("doc_id").alias("first"))
    table = materialize(firsts.groupBy("coarse").agg(F.sort_array(F.collect_set("first")).alias("firsts")), "starts")
    base, at = [], 0
    for c, size in sorted((r["coarse"], r["n"]) for r in table.select("coarse", F.size("firsts").alias("n")).collect()):
        base.append((c, at))
        at += max(1, size)
    table = table.join(rows.sparkSession.createDataFrame(base, "coarse int, base long"), "coarse")
    on = rows.withColumn("coarse", coarse).join(F.broadcast(table), "coarse")
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(F.size(F.filter("firsts", lambda c: c <= F.col("doc_id"))) - 1, F.lit(0)))
    on = on.withColumn("slice", F.col("base") + place).withColumn("starts", F.col("doc_id").isNotNull() & (F.col("slice") > 0) & F.array_contains("firsts", F.col("doc_id")))
    return on.drop("coarse", "firsts", "base"), at - 1


def _neighbours(df: DataFrame, id_col: str, text_col: str, hashed: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text, hash, next_id, next_text, next_hash of every row: the next row's by id (ties by text; null ids first), after the last the first's.

    The id order is cut into slices of about BUCKET_ROWS rows; the first rows of a slice are also sent, as ghosts, to
    the slice before. So one exchange and one window over bounded slices do. A text's hash travels with it.
    """
    rows = df.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    first = rows.agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("f")).select("f.doc_id").first()
    lead_id = first[0] if first else None
    rows, last = _sliced(rows, df.count())
    rows = rows.withColumn("canon", canonical(F.col("text"))).withColumn("hash", hashed(F.col("canon"))).drop("canon")
    head = F.col("doc_id").eqNullSafe(F.lit(lead_id).cast("long"))
    place = lambda slice_, ghost: F.array(F.struct(slice_.cast("long").alias("slice"), F.lit(ghost).alias("ghost")))
    none = F.array().cast("array<struct<slice:bigint,ghost:int>>")
    to = F.concat(place(F.col("slice"), 0), F.when(F.col("starts") & ~head, place(F.col("slice") - 1, 1)).otherwise(none), F.when(head, place(F.lit(last), 2)).otherwise(none))
    dealt = rows.select("doc_id", "text", "hash", F.explode(to).alias("to")).select("doc_id", "text", "hash", "to.slice", "to.ghost")
    order = W.partitionBy("slice").orderBy("ghost", F.col("doc_id").isNotNull(), "doc_id", "text")
    near = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "hash")] + [F.lead("doc_id").over(order).alias("next_id")]
    return dealt.select("*", *near).where("ghost = 0").select("doc_id", "text", "hash", "next_id", "next_text", "next_hash")


def _search(column: str, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most the column's value (null: none), by nested comparison."""

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        if hi - lo <= 32:
            part = F.array(*[F.lit(c).cast("long") for c in cuts[lo:hi]])
            return F.lit(lo) + F.size(F.filter(part, lambda c: c <= F.col(column)))
        mid = (lo + hi) // 2
        return F.when(F.col(column) < cuts[mid], node(lo, mid)).otherwise(node(mid, hi))

    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(node(0, len(cuts)))


def edited_text() -> Column:
    """``text`` with its last quarter (floor of a quarter of its code points) replaced by as many of ``next_text``."""
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))


def fingerprint_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike they are: 1.0 equal, 0.0 different.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null text counts as empty;
    texts may be of any length. A single row is its own next row; rows with equal or null ids are rows of their own,
    null first and ties by text. Other columns are not looked at, whatever their names. An empty table gives no rows.
    """
    near = _neighbours(df, id_col, text_col, hashed).withColumn("edited", edited_text())
    # a row is known by a hash of id and text, and what it finds is checked
    known = [F.xxhash64("doc_id", "text").alias("t"), F.xxhash64("next_id", "next_text").alias("nt")]
    both = near.withColumn("e_canon", canonical(F.col("edited"))).select("doc_id", *known, F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "hash", hashed(F.col("e_canon")).alias("e_hash"), "next_hash")
    both = materialize(both, "fingerprints")

    # byte comparison inside equal buckets, of texts and edited texts alike; an edited text equal to its own text is there already
    many = both.select(F.explode(F.array("hash", "e_hash")).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    many = materialize(many, "repeated")
    docs = df.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    canon = docs.select(canonical(F.col("text")).alias("canon"))
    texts = canon.withColumn("hash", hashed(F.col("canon"))).join(many, "hash", "left_semi").select("hash", "canon")
    docs = docs.select(F.xxhash64("id", "text").alias("k"), "text")
    edited = both.join(many, F.col("e_hash") == many["hash"], "left_semi").where("n_chars > 3").select("t", "nt", "e_hash").distinct()
    # both joins read one exchange of the documents, so these keep their names
    edited = edited.join(docs, F.col("t") == F.col("k")).select("nt", "e_hash", F.col("text").alias("own"))
    edited = edited.join(docs, F.col("nt") == F.col("k")).select("e_hash", F.col("own").alias("text"), F.col("text").alias("next_text"))
    edited = edited.select("e_hash", canonical(edited_text()).alias("canon"))
    texts = texts.unionByName(edited.where(F.col("e_hash") == hashed(F.col("canon"))).select(F.col("e_hash").alias("hash"), "canon"))
    apart = collisions(texts)
    if apart.isEmpty():
        alike = [(F.col("hash") == F.col(c)).cast("double").alias(name) for c, name in (("e_hash", "near_edited"), ("next_hash", "near_next"))]
        return both.select("doc_id", "n_chars", "edited_sha256", F.col("hash").alias("fingerprint"), F.col("e_hash").alias("edited_fingerprint"), *alike)
    forms = [canonical(F.col(c)) for c in ("text", "edited", "next_text")]
    again = near.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "hash", forms[0].alias("canon"), forms[1].alias("e_canon"), forms[2].alias("n_canon"))
    again = again.select("doc_id", "n_chars", "edited_sha256", "hash", "canon", hashed(F.col("e_canon")).alias("e_hash"), "e_canon", (F.col("canon") == F.col("e_canon")).cast("double").alias("near_edited"), (F.col("canon") == F.col("n_canon")).cast("double").alias("near_next"))
    once = _suffixed(again, apart).withColumnRenamed("fingerprint", "first_print").drop("hash", "canon")
    twice = _suffixed(once.withColumnRenamed("e_hash", "hash").withColumnRenamed("e_canon", "canon"), apart)
    return twice.select("doc_id", "n_chars", "edited_sha256", F.col("first_print").alias("fingerprint"), F.col("fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")
