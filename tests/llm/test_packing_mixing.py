"""Packing and mixing: round trips, bounds and targets."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kinsplit.llm import mixing, packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = (str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
SCHEMA = "doc_id long, text string, source string, length int, row int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, 0) for i, t, s in rows], SCHEMA)


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "anthing", "Öhl", "x1", "don't", "re-use", "<|endoftext|>", "\n\n", "日本", "a  b", "\t"]) for _ in range(n))


def test_tasks_hold_no_tokenizer_without_need():
    """Plain texts need the words' ids alone, and a task remembers few enough words to fit beside others."""
    ids = packing._Ids("/none", PATHS[1])
    assert ids.of("some plain text") == np.array(packing._Ids(*PATHS).tokenizer.encode("some plain text", add_special_tokens=False).ids, "<u4").tobytes()
    for k in range(packing.CACHE + 100):
        ids.known.setdefault(f"w{k}", b"") if len(ids.known) < packing.CACHE else ids.of(f"a w{k}")
    assert len(ids.known) <= packing.CACHE <= 100_000 and "tokenizer" not in vars(ids)


def test_words_of_a_batch_are_encoded_once_and_in_few_calls(monkeypatch):
    """Before, each word that was not remembered took a call of its own, wherever it stood."""
    words = [f"{a}{b}" for a in ("quo", "zür", "x1-", "d'", "it's") for b in ("rat", "öß", "9", ".", "\nnew")]
    rare = [" ".join(words[k:] + words[:k]) for k in range(len(words))]
    odd = [None, "", " ", "a", " a", "a ", "a\n", "\na", "a\n b", "a  b", "a\xa0 b", "日本 語 a", "a <|endoftext|> b", "a \n", "\x1c a", "é\x85 b", "b\t", "c\x1f"]
    texts = pa.array([*odd, *rare, None, *odd[::-1], *[chr(c) + "a" + chr(c) + " b" + chr(c) for c in range(0x260)]])
    ids, t = packing._Ids(*PATHS), packing._Ids(*PATHS).tokenizer
    wanted = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts.to_pylist()]
    for size in (1, 300, packing.TEXT_BYTES):
        for kind in (pa.string(), pa.large_string()):
            monkeypatch.setattr(packing, "TEXT_BYTES", size)
            monkeypatch.setattr(packing, "CACHE", 3)
            assert list(packing._Ids(*PATHS).of_all(texts.cast(kind))) == wanted
            assert list(packing._Ids(*PATHS).of_all(texts.cast(kind)[5:])) == wanted[5:]
            assert list(packing._Ids(*PATHS).of_all(pa.array(odd[11:12] * 2, kind))) == [wanted[11]] * 2
    assert list(packing._Ids(*PATHS).of_all(pa.array([], pa.string()))) == []
    assert list(packing._Ids(PATHS[0], None).of_all(texts[:20])) == wanted[:20]
    calls, of = [], ids.plain.encode_ordinary
    monkeypatch.setattr(ids.plain, "encode_ordinary", lambda x: calls.append(x) or of(x))
    assert list(ids.of_all(pa.array(rare))) == wanted[len(odd) : len(odd) + len(rare)]
    assert len(calls) <= len(rare) + 1 and len(ids.known) <= 3  # a call for each first word, and one for all the others


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(PATHS[0]), packing._Ids(*PATHS)
    texts = ["", " ", "  a", "a  b", "a \n b", "\n", "a b ", "don't stop", "x" * 5000, "tab\tb c", "é è", "ā b", "日本 語", "<|endoftext|> a", "a\u00a0b c", "a\u2003 b"] + [words(i, 40) for i in range(200)]
    texts += ["".join(random.Random(i).choice("ab \n\t'é1.ſ") for _ in range(30)) for i in range(2000)]
    for x in texts:
        assert np.frombuffer(ids.of(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_packing_is_gapless_whole_and_tight(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PART_ROWS", 40)
    t, cap = Tokenizer.from_file(PATHS[0]), 64
    rows = [(i, words(i, random.Random(i).randint(0, 120)), "s") for i in range(300)] + [(None, "null id", "s"), (5, "again", "s"), (5, "again", "s"), (900, None, "s"), (901, "", "s"), (902, "y " * 5000, "s")]
    got = packing.pack_documents(docs(spark, rows), *PATHS, capacity=cap).collect()
    want = {}
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append(ids)
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, texts in want.items():
        expect = []
        for ids in texts:
            first = len(ids) % cap or cap
            cuts = [0, *range(first, len(ids), cap), len(ids)]
            expect += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(pieces[i]) == sorted(expect)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= cap
    sizes = np.array([r["length"] for r in got])
    assert {(r["n_sequences"], r["least_sequences"]) for r in got} == {(len(bins), packing.lower_bound(sizes[sizes < cap], cap) + int((sizes == cap).sum()))}
    assert len(bins) <= packing.lower_bound(sizes, cap) * 1.03 + 2
    assert packing.pack_documents(docs(spark, []), *PATHS).count() == 0


def test_lower_bound_never_passes_the_optimum():
    r = random.Random(4)
    for _ in range(60):
        cap = r.choice([10, 12, 20])
        sizes = np.array([r.randint(1, cap) for _ in range(r.randint(1, 7))])
        assert packing.lower_bound(sizes, cap) <= optimum(sizes.tolist(), cap) <= packing.best_fit_decreasing(sizes, cap)[2]
    assert packing.lower_bound(np.array([7, 7, 7]), 10) == 3
    assert packing.lower_bound(np.array([], int), 10) == 0


def optimum(sizes, cap):
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best and k < len(sizes):
            return
        if k == len(sizes):
            best = min(best, len(bins))
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= cap:
                go(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = {s: weight[s] for s in order if s not in fixed}
        left = total - sum(fixed.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 2 * sizes[s] for s in over}


def mixed_rows():
    r = random.Random(8)
    rows = [(i, "w " * min(3000, int(r.expovariate(1 / 80))), r.choice(["hot"] * 8 + ["a", "é", "b", "Z", None, "tiny"][: 6 if i < 300 else 5])) for i in range(1500)]
    return rows + [(5000, None, "a"), (5001, "\x0b\x1c x\u00a0y", "b"), (None, "q q q", "b"), (5007, "same", "a"), (5007, "same", "a"), (5002, "one two", "single"), (5003, "", "void")]


def test_mix_meets_targets(spark):
    rows = mixed_rows()
    got = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, list(reversed(rows))).repartition(7)).collect()
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for _, t, s in rows:
        sums[s] = sums.get(s, 0) + size(t)
    want = targets_by_hand(sums)
    source = {}
    for i, _, s in rows:
        source[i] = s
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sums[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sums:
        assert abs(taken[s] - want[s]) <= max(2, 0.02 * want[s]), s
    assert len(got) == len(rows) and sorted((r["doc_id"] or -1, r["taken"]) for r in got) == sorted((r["doc_id"] or -1, r["taken"]) for r in again)


def solved(cells, target, cap=2.0):
    """The dual of one source by bisection: sum of size * n * min(cap, exp(lam * size / mean))."""
    mean = sum(s * n for s, n in cells.items()) / sum(cells.values())
    lo, hi = -1e4, 1e4
    for _ in range(300):
        lam = (lo + hi) / 2
        got = sum(s * n * min(cap, np.exp(min(50.0, lam * s / mean))) for s, n in cells.items())
        lo, hi = (lam, hi) if got < target else (lo, lam)
    return {s: min(cap, float(np.exp(min(50.0, lam * s / mean)))) for s in cells}


def test_rates_are_those_of_the_dual(spark, monkeypatch):
    """Copies by size follow the tilted rates that a plain solver finds, with slices of any number."""
    monkeypatch.setattr(mixing, "SLICE", 7)
    r = random.Random(3)
    rows = [(i, "w " * r.choice([1, 5, 20, 60, 200]), r.choice(["a"] * 5 + ["b", "b", "c"])) for i in range(2000)]
    got = mixing.mix(docs(spark, rows)).collect()
    source = {i: s for i, _, s in rows}
    cells, copies, target = {}, {}, {}
    for x in got:
        s = source[x["doc_id"]]
        target[s] = x["target"]
        cells.setdefault(s, {})[x["size"]] = cells.get(s, {}).get(x["size"], 0) + 1
        copies[s, x["size"]] = copies.get((s, x["size"]), 0) + x["copies"]
    for s, c in cells.items():
        for size, rate in solved(c, target[s]).items():
            assert abs(copies[s, size] - rate * c[size]) <= 4.01


def test_very_long_documents_are_made_up_for(spark):
    rows = [(i, "w " * (20 + i % 60), "a") for i in range(150)] + [(500 + i, "v " * 3001, "a") for i in range(3)] + [(900 + i, "u " * 50, "b") for i in range(300)]
    got = mixing.mix(docs(spark, rows)).collect()
    for s in ("a", "b"):
        mine = [r for r in got if (r["doc_id"] < 900) == (s == "a")]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 80


def test_unsolved_dual_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NEWTON_STEPS", 1)
    with pytest.raises(RuntimeError, match="not solved"):
        mixing.mix(docs(spark, [(i, "w " * (1 + i % 5), "aaab"[i % 4]) for i in range(50)]))


def test_one_row_of_an_id_is_moved(spark):
    rows = [(1, "w " * (3 + i % 50), "a") for i in range(400)] + [(None, "w " * (3 + i % 50), "b") for i in range(200)] + [(None, "v " * 400, "b"), (3, "u " * 90, "c")]
    got = mixing.mix(docs(spark, rows)).collect()
    words = {}
    for r in got:
        words.setdefault(r["target"], []).append(r["taken"])
    assert all(abs(sum(v) - t) <= 0.02 * t + 2 for t, v in words.items())


def test_take_copies_keeps_columns_of_any_name(spark):
    names = ["_copies", "_copy", "_id", "_m_copies", "a.b", "copies"]
    df = spark.createDataFrame([(i, f"{i} w w", "s", *names) for i in range(30)] + [(None, "x", "s", *names)], ["doc_id", "text", "source", *names])
    out = mixing.take_copies(df)
    assert out.columns == df.columns and all(tuple(r)[3:] == tuple(names) for r in out.collect())
    assert out.where("doc_id is null").count() == 1


def test_take_copies_repeats_rows(spark):
    rows = [(i, f"{i} " + "w " * (i % 9), "ab"[i % 2]) for i in range(80)]
    df = docs(spark, rows)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    out = mixing.take_copies(df)
    assert out.columns == df.columns
    seen = {}
    for r in out.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {i: c for i, c in copies.items() if c}


def test_mix_of_little(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.take_copies(docs(spark, [])).count() == 0
    r = mixing.mix(docs(spark, [(1, None, None)])).first()
    assert (r["size"], r["source_size"], r["target"], r["taken"]) == (0, 0, 0.0, 0)
