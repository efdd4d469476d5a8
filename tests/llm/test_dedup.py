"""Exact and near dedup against brute force."""

import functools
import hashlib
import random

import numpy as np
import pytest

from kinsplit.llm import exact_dedup, near_dedup
from kinsplit.plans import hot
from kinsplit.llm.near_dedup import BANDS, ROWS, Shingler, _weighted, probability_jaccard, probminhash

SCHEMA = "doc_id long, text string, keep_id string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def text_of(seed, n=80):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def edited(text, k, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"new{r.random()}"
    return " ".join(w)


@functools.cache
def bag(t):
    w = t.lower().split()
    out = {}
    for x in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []):
        out[x] = out.get(x, 0) + 1
    return out


def jp(a, b):
    """Probability Jaccard by its definition."""
    a, b = bag(a), bag(b)
    keys = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in keys) for d in a.keys() & b.keys())


def linked(a, b):
    both = bag(a).keys() & bag(b).keys()
    if not both or min(sum(x[d] for d in both) / sum(x.values()) for x in (bag(a), bag(b))) < 0.8:  # a bound of J_P
        return False
    return jp(a, b) >= 0.8


def test_exact_groups_match_brute_force(spark):
    rows = [(i, random.Random(i).choice(["", "a", "A", "b " * 50, None, "x" * 100_000])) for i in range(60)] + [(None, "a"), (None, "only null id"), (7, "a"), (7, "a"), (None, "only null id")]
    got = exact_dedup.exact_groups(docs(spark, rows)).collect()
    want = {}
    for i, t in rows:
        want.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        top = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (top, len(ids), r["doc_id"] == top)


def test_hot_groups_and_many_segments(spark, monkeypatch):
    """However small segments and the filter are, and however large a group is, results are whole."""
    monkeypatch.setattr(exact_dedup, "SEGMENT_ROWS", 50)
    monkeypatch.setattr(hot, "LEAST", 20)
    monkeypatch.setattr(hot, "SHARE", 4)
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 2}" if i % 3 == 1 else f"own {i}") for i in range(900)] + [(i + 5000, f"pair {i}") for i in range(0, 200, 7)]
    sizes = {}
    for i, t in rows:
        sizes.setdefault(t, []).append(i)
    for limit in (64 << 20, 0):
        got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs(spark, rows).repartition(6), max_filter_bytes=limit).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(sizes[t]), len(sizes[t]), i == max(sizes[t]))


def test_columns_of_any_name_stay(spark):
    names = ["_sha", "_SHA", "_maybe", "_of", "_keep", "_k_sha", "_gone", "a.b", "class_id", "key"]
    df = spark.createDataFrame([(1, "a b", *names), (2, "a b", *names), (3, "c d", *names)], ["doc_id", "text", *names[:1], *names[2:]][:2] + ["_sha", "_sha_1", *names[2:]])
    for drop, want in ((exact_dedup.drop_exact_duplicates, [2, 3]), (near_dedup.drop_near_duplicates, [1, 3])):
        out = drop(df)
        assert out.columns == df.columns
        assert sorted(r["doc_id"] for r in out.collect()) == want
        assert out.first()["a.b"] == "a.b" and out.first()["_sha"] == "_sha"


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_drop_exact_leaves_one_of_each_text(spark, limit):
    rows = [(i, f"t{i % 5}") for i in range(40)] + [(100, "t1"), (100, "t1"), (None, "t2"), (None, None), (3, "")]
    kept = exact_dedup.drop_exact_duplicates(docs(spark, rows), max_filter_bytes=limit)
    assert kept.columns == ["doc_id", "text", "keep_id", "n"]
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == sorted([(35, "t0"), (100, "t1"), (37, "t2"), (38, "t3"), (39, "t4"), (3, "")])


def test_filter_never_misses_a_repeat(spark):
    h = [random.Random(i).getrandbits(63) - (1 << 62) for i in range(5000)] * 2 + [random.Random(-i).getrandbits(62) for i in range(1, 20000)]
    df = spark.createDataFrame([(x,) for x in h], "h long").repartition(5)
    probe = exact_dedup.repeat_filter(df, len(h))
    flagged = {r["h"] for r in df.where(probe(df["h"])).collect()}
    assert set(h[:5000]) <= flagged
    assert len(flagged) < 5000 + 2000


def test_empty_tables(spark):
    e = docs(spark, [])
    assert exact_dedup.exact_groups(e).count() == 0
    assert exact_dedup.drop_exact_duplicates(e).count() == 0
    assert near_dedup.near_groups(e).count() == 0
    assert near_dedup.drop_near_duplicates(e).count() == 0


def test_shingles_match_python():
    texts = ["a b c d e f", "", "  a\tb\nc d  e ", "one", "x y", "ünï cödé wörds äre fïne töö", "a b c d e f"]
    data = "".join(texts).encode()
    ends = np.cumsum([len(t.encode()) for t in texts])
    starts = ends - [len(t.encode()) for t in texts]
    rows, h = Shingler().hashes(np.frombuffer(data, np.uint8), starts, ends)
    got = [sorted(h[rows == i].tolist()) for i in range(len(texts))]
    assert [len(g) for g in got] == [2, 0, 1, 1, 1, 2, 2]
    assert got[0] == got[6] and set(got[2]) <= set(got[0])


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    h = r.integers(1, 1 << 62, 400).astype(np.uint64)
    wa, wb = r.integers(1, 5, 400), r.integers(1, 5, 400)
    a, b = slice(0, 300), slice(60, 400)
    rows = np.concatenate([np.zeros(300, np.int64), np.ones(340, np.int64)])
    sig = probminhash(*_weighted_with(rows, np.concatenate([h[a], h[b]]), np.concatenate([wa[a], wb[b]])), 2, 4000)
    true = probability_jaccard(*_sorted(h[a], wa[a]), *_sorted(h[b], wb[b]))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def _weighted_with(rows, h, w):
    return rows, h, w


def _sorted(h, w):
    o = np.argsort(h)
    return h[o], w[o]


def test_exact_similarity_matches_definition():
    r = random.Random(3)
    for _ in range(20):
        a = [r.choice("abcdefg") for _ in range(r.randint(5, 30))]
        b = a[: r.randint(3, len(a))] + [r.choice("abcdefg") for _ in range(r.randint(0, 9))]
        ta, tb = " ".join(a), " ".join(b)
        data = (ta + tb).encode()
        rows, h, w = _weighted(*Shingler().hashes(np.frombuffer(data, np.uint8), np.array([0, len(ta)]), np.array([len(ta), len(ta + tb)])))
        got = probability_jaccard(h[rows == 0], w[rows == 0], h[rows == 1], w[rows == 1])
        assert got == pytest.approx(jp(ta, tb))


def brute_classes(rows):
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(rows):
        for j, b in rows[x + 1 :]:
            if (a or "").lower() == (b or "").lower() or linked(a or "", b or ""):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: find(i) for i in ids}


def test_near_groups_match_brute_force(spark):
    rows, passage = [], text_of(999, 120)
    for k in range(12):
        base = text_of(k)
        rows += [(100 * k, base), (100 * k + 1, edited(base, 1, k)), (100 * k + 2, edited(base, 3, k)), (100 * k + 3, base.upper()), (100 * k + 4, edited(base, 9, k))]
    for k in range(40):  # share a passage and little else, or nearly all
        own = text_of(5000 + k, 15 + k * 2)
        rows += [(9000 + 2 * k, passage + " " + own), (9001 + 2 * k, passage + " " + edited(own, 2, k))]
    rows += [(9900, ""), (9901, None), (9902, "  "), (9903, "two words"), (9904, "Two words"), (9905, "long " * 300)]
    want = brute_classes(rows)
    got = {r["doc_id"]: r for r in near_dedup.near_groups(docs(spark, rows + [(None, "a"), (None, None)])).collect() if r["doc_id"] is not None}
    wrong = [i for i in want if got[i]["class_id"] != want[i]]
    assert not wrong
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(got[i]["class_size"] == sizes[want[i]] for i in want)


def test_large_classes_are_compared_through_their_stars(spark, monkeypatch):
    """Chains of near copies around a shared passage, with every class large and every bucket wide: still exact."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "PROBES", 4)
    monkeypatch.setattr(near_dedup, "WIDE", 5)
    monkeypatch.setattr(near_dedup, "FEW", 2)
    rows, passage = [], text_of(77, 150)
    for family in range(4):
        own = text_of(300 + family, 40)
        for k in range(14):
            rows.append((family * 100 + k, passage + " " + edited(own, k, family * 50 + k)))
    rows += [(1000 + k, edited(passage, 1 + k % 9, k)) for k in range(20)]
    want = brute_classes(rows)
    for rounds in (0, 1, 2):
        got = {r["doc_id"]: r for r in near_dedup.near_groups(docs(spark, rows), pivot_rounds=rounds).collect()}
        assert {i: r["class_id"] for i, r in got.items()} == want
        assert all(r["class_links"] >= r["class_size"] - 1 for r in got.values())


def test_distance_is_a_metric():
    """What the stars rest on."""
    r = np.random.default_rng(3)
    for _ in range(300):
        bags = [(np.sort(r.choice(12, r.integers(1, 12), replace=False)).astype(np.uint32), None) for _ in range(3)]
        bags = [(h, r.integers(1, 6, len(h)).astype(np.uint32)) for h, _ in bags]
        d = lambda i, j: 1 - probability_jaccard(*bags[i], *bags[j])
        assert d(0, 2) <= d(0, 1) + d(1, 2) + 1e-12


def test_one_id_with_several_texts(spark):
    a, b, c = text_of(1), text_of(2), text_of(3)
    rows = [(1, a), (1, b), (1, b), (2, edited(a, 1, 5)), (3, edited(b, 1, 6)), (4, c), (5, edited(c, 1, 7)), (6, b), (7, c), (7, text_of(9))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in near_dedup.near_groups(docs(spark, rows)).collect())
    assert got == sorted([(i, 1, 6) for i in (1, 1, 1, 2, 3, 6)] + [(i, 4, 4) for i in (4, 5, 7, 7)])
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_very_long_texts_are_near_copies(spark):
    long = text_of(5, 30_000)
    rows = [(1, long), (2, edited(long, 400, 1)), (3, text_of(6, 30_000))]
    assert sorted((r["doc_id"], r["class_id"]) for r in near_dedup.near_groups(docs(spark, rows)).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_near_groups_of_one_hot_class(spark):
    """Copies of one text with few links through any single pivot."""
    base = text_of(1, 200)
    rows = [(i, edited(base, 4 + i % 8, i)) for i in range(120)]
    want = brute_classes(rows)
    for rounds in (0, 1, 3):
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(docs(spark, rows), pivot_rounds=rounds).collect()}
        assert got == want


def test_rows_of_null_id_stay_and_columns_are_kept(spark):
    kept = near_dedup.drop_near_duplicates(docs(spark, [(1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")]))
    assert kept.columns == ["doc_id", "text", "keep_id", "n"]
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1]


def test_band_numbers_miss_next_to_nothing():
    assert (1 - 0.8**ROWS) ** BANDS < 2e-5
