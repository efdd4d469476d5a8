"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and columns named like its own."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from kinsplit.llm import chat, exact_dedup, fingerprints, html_extract, mixing, near_dedup, packing, secret_scan, toxicity, url_filter  # noqa: E402
from kinsplit.llm.catalog import tokenizer_paths  # noqa: E402

ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "x y z"), (None, None), (3, ""), (4, "long words " * 60_000), (5, "<p>" + "y" * 100_000), (1 << 61, "a b c d e f")]
EXTRA = ["id", "key", "h", "hash", "slice", "starts", "bucket", "row", "length", "size", "copies", "place", "off", "text_sha256", "maybe", "keep_id", "class_id", "next_text", "a.b", "`c", "host", "rule", "turns", "segments", "page_id", "html", "url"]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    return df.withColumns({c if "`" not in c else c: F.lit(c) for c in EXTRA})


OPERATORS = {
    "op1": exact_dedup.exact_groups,
    "op2": near_dedup.near_groups,
    "op3": fingerprints.fingerprint_report,
    "op3_plain": fingerprints.fingerprints,
    "op4": lambda d: packing.pack_documents(d, *tokenizer_paths()).where("piece = 0"),
    "op5": lambda d: html_extract.extract_pages(d, id_col="doc_id", url_col="source", html_col="text"),
    "op6": secret_scan.scan_secrets,
    "op8": mixing.mix,
    "op9": lambda d: url_filter.filter_urls(d, id_col="doc_id", url_col="text"),
    "op10": lambda d: toxicity.score(d, toxicity.ToxicityModel({"x": 1.0}, -1.0)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_tables(spark, name):
    df = table(spark, ROWS)
    out = OPERATORS[name](df)
    got = sorted(str(r[0]) for r in out.select(out.columns[0]).collect())
    assert got == sorted(str(i) for i, _ in ROWS)
    empty = OPERATORS[name](df.limit(0))
    assert empty.columns == out.columns and empty.count() == 0


def test_dropping_and_taking_keep_the_columns(spark):
    df = table(spark, ROWS)
    for run in (exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates, mixing.take_copies):
        out = run(df)
        assert out.columns == df.columns
        assert all(tuple(r)[3:] == tuple(EXTRA) for r in out.collect())
        assert run(df.limit(0)).count() == 0


def test_odd_conversations(spark):
    df = table(spark, ROWS).withColumn("turn", F.lit(None).cast("long")).withColumn("role", F.lit("assistant"))
    out = chat.read_back(chat.format_conversations(df, conv_col="doc_id"))
    assert sorted((str(r["conv_id"]), r["n_turns"]) for r in out.collect()) == sorted([("1", 2), ("2", 1), ("None", 2), ("3", 1), ("4", 1), ("5", 1), (str(1 << 61), 1)])
