"""The pipeline against a plain version of its stages."""

import random
from zlib import crc32

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from kinsplit.llm import catalog, toxicity  # noqa: E402
from tests.llm.test_dedup import brute_classes, edited, text_of  # noqa: E402
from tests.llm.test_packing_mixing import targets_by_hand  # noqa: E402


def corpus():
    r, rows, labels = random.Random(4), [], []
    for i in range(0, 400, 2):
        t = text_of(i, r.randint(20, 90)) + (" " + " ".join(r.choice(["vilest", "scumbag", "filthiest"]) for _ in range(4)) if i % 10 == 0 else "")
        rows.append((i, t, "en", r.choice(["web", "web", "web", "wiki", "books", None])))
        labels.append((i, 1, int(i % 10 == 0)))
    rows += [(1001 + k, rows[3 + 7 * k][1], "en", "wiki") for k in range(20)]
    rows += [(2001 + k, edited(rows[4 + 7 * k][1], 1, k), "en", "web") for k in range(20)]
    return [*rows, (3001, None, "en", "web"), (3003, "", "en", "web"), (3005, "x " * 2500, "en", "web"), (None, "no id here", None, None)], labels


def write(spark, path, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), "a", "b", "c") for i, t, lang, s in rows], ["doc_id", "text", "lang", "source", "n_chars", "toxicity_score", "a.b", "_sha"])
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def plain(spark, path, rows):
    """doc_ids after each filtering stage, by brute force; scores come from the model itself."""
    model = toxicity.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    clean = [r for r, p in zip(rows, model.scores([t for _, t, _, _ in rows])) if p < 0.5]
    keep = {}
    for i, t, _, _ in clean:
        keep[t or ""] = max(keep.get(t or "", -1), -1 if i is None else i)
    exact = [r for r in clean if (-1 if r[0] is None else r[0]) == keep[r[1] or ""]]
    classes = brute_classes([(i, t) for i, t, _, _ in exact if i is not None])
    near = [r for r in exact if r[0] is None or classes[r[0]] == r[0]]
    return clean, exact, near


def ids(rows):
    return sorted(-1 if i is None else i for i in rows)


def test_stages_match_a_plain_version(spark, tmp_path):
    rows, labels = corpus()
    write(spark, str(tmp_path), rows, labels)
    want = plain(spark, str(tmp_path), rows)
    toxic = {i for i, _, y in labels if y and crc32(str(i).encode()) % 5 == 0}
    assert toxic and not toxic & {r[0] for r in want[0]} and len(want[0]) > 0.7 * len(rows)
    docs, names = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        names = names or docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert docs.columns == names and docs.where("toxicity_score != 'a' or `a.b` != 'b' or _sha != 'c'").count() == 0
        if k < 3:
            assert ids(r["doc_id"] for r in docs.collect()) == ids(r[0] for r in want[k])
    sizes, taken = {}, {}
    for _, t, _, s in want[2]:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for r in docs.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
    for s, t in targets_by_hand(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 0.02 * t + 3
    mixed = ids(r["doc_id"] for r in docs.collect())

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert ids(r["doc_id"] for r in packed if r["piece"] == 0) == mixed
    room = {}
    for r in packed:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in room.values():
        assert sum(n for _, n in parts) <= 2048 and all(o == sum(n for _, n in sorted(parts)[:k]) for k, (o, _) in enumerate(sorted(parts)))
    assert len(room) == packed[0]["n_sequences"] <= packed[0]["least_sequences"] * 1.05 + 2


def test_pipeline_of_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), corpus()[0][:1], corpus()[1][:1])
    empty = tmp_path / "empty"
    for name in ("documents", "labels"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
    assert catalog.op10_toxicity(spark, str(empty)).count() == 0
