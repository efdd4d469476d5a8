"""Kernels, edges, neighbours, graphs, clusters, communities, index and files."""

import math
import random

import numpy as np
import pytest

from kinsplit.config import CoverageMode, GlobalIdentityMode, HNSWConfig, INWeightType, KernelVariant, LeidenObjective, LocalIdentityMode, NormMode, ScoringMatrix
from kinsplit.functions.alignment import GlobalAligner, LocalAligner
from kinsplit.functions.fingerprints import BitFingerprint, RealFingerprint
from kinsplit.functions.kernels import TanimotoBit, TanimotoReal
from kinsplit.functions.structure import PdbStructure, USAlignKernel
from kinsplit.operators import clusters, communities, proximity
from kinsplit.operators.ann import HNSWIndex, HNSWState
from kinsplit.operators.components import star_forest
from kinsplit.operators.edges import EdgeStore
from kinsplit.sources import sequences

SEQS = ["ACDEFGHIKLMNPQRSTVWY", "ACDAFGHKILMNPQRSTVWY", "ACDEFGHIPLMNPQRSTVWY", "ACDEFGHIKLMIJKPPWY", "GGLLPLPKLMNKKKSTVGG"]


def items(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"id long, item {kind}")


def store(spark, n, edges):
    return EdgeStore(n, spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double"))


def test_global_distances():
    g = GlobalAligner()
    want = {(0, 1): 0.15, (0, 2): 0.05, (0, 3): 0.35, (0, 4): 0.6522, (1, 3): 0.5, (1, 4): 0.7, (2, 3): 0.4, (3, 4): 0.7826}
    for (i, j), d in want.items():
        assert g(SEQS[i], SEQS[j]) == pytest.approx(d, abs=1e-4)
    assert [round(g(*p), 4) for p in (("AEP", "PPP"), ("PEA", "AEA"), ("ACDEFGHIKLM", "ACDEFGHIKLM"))] == [0.6667, 0.3333, 0.0]
    assert g("", "") == 0.0 and g("", "A") == 1.0


def test_alignment_matches_plain_dynamic_programming():
    def score(a, b, local, o=5, e=2):
        t = lambda x, y: 2 if x == y else -1
        low = -(10**9)
        h = [[0 if local else low] * (len(b) + 1) for _ in range(len(a) + 1)]
        up, left = [[low] * (len(b) + 1) for _ in h], [[low] * (len(b) + 1) for _ in h]
        h[0][0] = 0
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i:
                    up[i][j] = max(h[i - 1][j] - o, up[i - 1][j] - e)
                if j:
                    left[i][j] = max(h[i][j - 1] - o, left[i][j - 1] - e)
                if i or j:
                    best = max(up[i][j], left[i][j], h[i - 1][j - 1] + t(a[i - 1], b[j - 1]) if i and j else low)
                    h[i][j] = max(best, 0) if local else best
        return max(map(max, h)) if local else h[-1][-1]

    from kinsplit.functions.alignment import align
    from kinsplit.functions.matrices import matrix_table

    r = random.Random(1)
    pairs = [("".join(r.choice("ACGT") for _ in range(r.randint(0, 12))), "".join(r.choice("ACGT") for _ in range(r.randint(0, 12)))) for _ in range(200)]
    table = matrix_table({(x, y): 2 if x == y else -1 for x in "ACGT" for y in "ACGT"})
    for local in (False, True):
        got = align([a for a, _ in pairs], [b for _, b in pairs], table, 5, 2, local)[0]
        assert got.tolist() == [score(a, b, local) for a, b in pairs]


def test_aligner_modes_and_errors(tmp_path, monkeypatch):
    a, b = "MKTAYIAK", "MKTAYIAKQR"
    for mode, d in ((GlobalIdentityMode.AlignmentLength, 0.2), (GlobalIdentityMode.MaxSeqLength, 0.2), (GlobalIdentityMode.MinSeqLength, 0.0), (GlobalIdentityMode.MaxLength, 0.2)):
        assert GlobalAligner(identity_mode=mode)(a, b) == pytest.approx(d)
    assert LocalAligner(min_coverage=0.5, cov_mode=CoverageMode.Query)("ACDEFGHIKLM", "CDEFGHI") == 0.0
    assert LocalAligner()("ACDEFGHIKLM", "CDE") == 1.0 and LocalAligner(min_coverage=0)("AAA", "") == 1.0
    assert LocalAligner(min_coverage=0.2, identity_mode=LocalIdentityMode.MinSeqLength)("ACDEFGHIKLM", "CDEFGHI") == 0.0
    for bad in (lambda: GlobalAligner(gap_open=-1), lambda: LocalAligner(min_coverage=1.5), lambda: GlobalAligner(matrix=ScoringMatrix.Pam250)):
        with pytest.raises(ValueError):
            bad()
    assert GlobalAligner(matrix=ScoringMatrix.Identity)("AC", "AC") == 0.0 and GlobalAligner(matrix=ScoringMatrix.Nuc44)("ACGT", "ACCT") == 0.25
    (tmp_path / "PAM250").write_text("# a matrix\n   A  C\nA  2 -2\nC -2 12\n")
    monkeypatch.setenv("KINSPLIT_MATRICES", str(tmp_path))
    assert GlobalAligner(matrix=ScoringMatrix.Pam250)("AC", "AC") == 0.0


def test_fingerprints():
    f = BitFingerprint([True, False, True, True, False])
    assert (len(f), f.count(), f.on_bits()) == (5, 3, [0, 2, 3])
    assert BitFingerprint.from_np(f.to_np()).to_list() == f.to_list() and BitFingerprint.from_list([1, 0, 1, 0, 1]).count() == 3
    assert BitFingerprint.random(100, 7).count() == 7
    with pytest.raises(ValueError):
        BitFingerprint.random(3, 4)
    for bad in (object(), [0.5, 2]):
        with pytest.raises(TypeError):
            BitFingerprint(bad)
    r = RealFingerprint([1, 0, 2])
    assert len(r) == 3 and r.norm_sq() == 5 and RealFingerprint(r.to_np()).to_list() == [1, 0, 2]
    with pytest.raises(TypeError):
        RealFingerprint("abc")
    assert TanimotoBit()(BitFingerprint([1, 0, 1, 1]), BitFingerprint([1, 1, 1, 0])) == pytest.approx(0.5)
    assert TanimotoReal()([1, 0, 1], [0, 1, 1]) == pytest.approx(0.6667, abs=1e-4)
    assert TanimotoBit()([], []) == 0 and TanimotoReal()([0, 0], [0, 0]) == 0


def test_exact_edges_and_neighbors_of_sequences(spark):
    v = items(spark, SEQS)
    e = proximity.exact_edges(KernelVariant.AlignmentGlobal, v, 0.5)
    assert sorted((a, b) for a, b, _ in e) == [(0, 1), (0, 2), (0, 3), (1, 2), (2, 3)]
    assert len(e) == 5 and e.node_count == 5 and e[0][:2] == (0, 1) and e[-1][:2] == (2, 3)
    with pytest.raises(IndexError):
        e[5]
    near = proximity.exact_nearest_neighbors(KernelVariant.AlignmentGlobal, v.where("id > 2"), v.where("id <= 2"), 2)
    assert [(r["query_id"], r["ref_id"]) for r in near.orderBy("query_id", "rank").collect()] == [(3, 0), (3, 2), (4, 0), (4, 2)]


@pytest.mark.parametrize("theta", [0.0, 0.3, 0.7, 1.0, 1.2])
def test_edges_match_brute_force(spark, theta, monkeypatch):
    r = random.Random(3)
    sets = [sorted(r.sample(range(14), r.randint(0, 9))) for _ in range(60)]
    vecs = [[r.choice([0.0, 1.0, 2.0, -1.0]) for _ in range(4)] for _ in range(60)]
    monkeypatch.setattr(TanimotoReal, "rows_per_block", 9)
    monkeypatch.setattr(TanimotoBit, "rows_per_block", 9)
    for kernel, values, kind in ((TanimotoBit(), sets, "array<int>"), (TanimotoReal(), vecs, "array<double>")):
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if kernel(values[i], values[j]) < theta}
        got = [(a, b) for a, b, _ in proximity.exact_edges(kernel, items(spark, values, kind), theta)]
        assert len(got) == len(set(got)) and set(got) == want


def test_real_kernel_rules_out_no_near_pair():
    """Products of single precision against all distances, ties and thresholds between pairs included."""
    r, k = np.random.default_rng(5), TanimotoReal()
    a = r.normal(size=(60, 16)) * r.choice([1e-6, 1.0, 1e3], 60)[:, None]
    b = np.concatenate([r.normal(size=(500, 16)), a[:30], a[:30], np.zeros((1, 16)), a[:20] * 1.0001])
    d = k.block(a, b)
    for t in (-0.1, 1e-10, 0.4, 0.99, 1.2, float(np.sort(d.ravel())[2000]) + 1e-12):
        i, j, w = k.near(a, b, t)
        want = np.zeros_like(d, bool)
        want[i, j] = True
        assert (want == (d < t)).all() and np.allclose(w, d[i, j], atol=1e-12)
    b = np.concatenate([b[:560], a[:20] * 1.0001])
    d = np.round(k.block(a, b), 9)
    top, w = k.nearest(a, b, 5)
    assert (top == np.argsort(d, axis=1, kind="stable")[:, :5]).all() and np.allclose(w, np.sort(d, axis=1)[:, :5], atol=1e-9)
    assert k.near(np.zeros((2, 3)), np.zeros((2, 3)), 0.5)[2].tolist() == [0.0] * 4


def test_bit_kernel_rules_out_no_near_pair():
    """Counts by hash against all distances: empty, large, equal and disjoint sets; sets are held as numbers, not objects."""
    import pyarrow as pa

    r, k = np.random.default_rng(6), TanimotoBit()
    make = lambda n: [r.choice(900, s, replace=False) * 7919 - 3_000_000 for s in r.choice([0, 1, 5, 40, 300, 800], n)]
    a, b = make(40), make(70)
    b += [x[: max(1, len(x) * 3 // 4)] for x in a] + a[:10]
    d = k.block(k.load(a), k.load(b))
    x, y = (k.load_column(pa.chunked_array([pa.array([[], *v], pa.list_(pa.int64()))]).slice(1)) for v in (a, b))
    for t in (0.0, 0.3, 0.5, 0.9, 1.0, 2.0):
        i, j, w = k.near(x, y, t)
        want = np.zeros_like(d, bool)
        want[i, j] = True
        assert (want == (d < t)).all() and (w == d[i, j]).all()
    top, w = k.nearest(x, y, 4)
    assert (top == np.argsort(d, axis=1, kind="stable")[:, :4]).all() and (w == np.sort(d, axis=1)[:, :4]).all()


def test_blocks_of_large_items_hold_fewer(spark):
    from pyspark.sql import functions as F

    from kinsplit.plans import blocks

    placed, spans = blocks.by_size(spark.range(1000).select("id", F.lit(1.0).alias("item")), F.when(F.col("id") < 900, 1.0).otherwise(500.0), 100, most_size=5000)
    assert placed.groupBy("block").agg(F.sum(F.when(F.col("id") < 900, 1).otherwise(500)).alias("s")).agg(F.max("s")).first()[0] < 12_000


def test_blocks_grow_with_the_table(spark):
    """No more blocks of cheap distances than most_blocks, so that each item is copied that often at most."""
    from pyspark.sql import functions as F

    from kinsplit.plans import blocks

    placed, spans = blocks.by_size(spark.range(4000).select("id", F.lit(1.0).alias("item")), F.lit(0.0), 20, 8)
    assert len(spans) <= 8 and placed.count() == 4000
    assert len(blocks.by_size(spark.range(4000).select("id", F.lit(1.0).alias("item")), F.lit(0.0), 20, 8, 40)[1]) == 100


def test_edges_copy_a_row_few_times(spark, monkeypatch):
    """Of real vectors of alike sizes, each block meets all others, so a row is copied once a block."""
    from kinsplit.plans import blocks

    made, real = [], blocks.packed
    monkeypatch.setattr(TanimotoReal, "rows_per_block", 5)
    monkeypatch.setattr(blocks, "packed", lambda placed, n: made.append(n) or real(placed, n))
    vecs = np.random.default_rng(4).normal(size=(300, 6)).tolist()
    got = {(a, b): w for a, b, w in proximity.exact_edges(KernelVariant.TanimotoReal, items(spark, vecs, "array<double>"), 0.6)}
    x = np.array(vecs)
    d = TanimotoReal().block(x, x)
    assert sorted(got) == [(a, b) for a in range(300) for b in range(a + 1, 300) if d[a, b] < 0.6]
    assert made[0] <= TanimotoReal.edge_blocks + 3 < 300 / 5


def test_neighbors_over_blocks(spark, monkeypatch):
    r = np.random.default_rng(0)
    vecs = r.normal(size=(40, 5)).tolist()
    monkeypatch.setattr(TanimotoReal, "rows_per_block", 7)
    k = TanimotoReal()
    got = proximity.exact_nearest_neighbors(k, items(spark, vecs, "array<double>"), items(spark, vecs, "array<double>"), 4).orderBy("query_id", "rank").collect()
    for i in range(40):
        want = sorted((round(k(vecs[i], v), 9), j) for j, v in enumerate(vecs))[:4]
        assert [x["ref_id"] for x in got if x["query_id"] == i] == [j for _, j in want]


def test_neighbors_skip_blocks_that_sizes_rule_out(spark, monkeypatch):
    """Sizes far apart: the same neighbours, from far fewer meetings of blocks; ties and k over all rows included."""
    r = random.Random(9)
    sets = [sorted(r.sample(range(400), r.choice([0, 2, 3, 20, 30, 150, 200]))) for _ in range(120)]
    queries = sets[::4] + [sorted(r.sample(range(400), n)) for n in (1, 9, 60, 300)]
    k, kernel = 5, TanimotoBit()
    monkeypatch.setattr(TanimotoBit, "rows_per_block", 10)
    for some, n in ((sets, k), (sets[:3], k), ([], k)):
        got = {}
        for x in proximity.exact_nearest_neighbors(kernel, items(spark, queries, "array<int>"), items(spark, some, "array<int>"), n).orderBy("rank").collect():
            got.setdefault(x["query_id"], []).append(x["ref_id"])
        for i, q in enumerate(queries):
            want = sorted((round(kernel(q, s), 9), j) for j, s in enumerate(some))[:n]
            assert got.get(i, []) == [j for _, j in want]


def test_zip_needs_the_same_ids(spark):
    a, b = items(spark, ["AEP", "PEA", "ACDEFGHIKLM"]), items(spark, ["PPP", "AEA", "ACDEFGHIKLM"])
    got = [round(r["distance"], 4) for r in proximity.zip_kernel(KernelVariant.AlignmentGlobal, a, b).orderBy("id").collect()]
    assert got == [0.6667, 0.3333, 0.0]
    with pytest.raises(ValueError):
        proximity.zip_kernel(KernelVariant.AlignmentGlobal, a, b.limit(2))
    with pytest.raises(Exception, match="must not be null"):
        proximity.zip_kernel(KernelVariant.AlignmentGlobal, items(spark, [None]), items(spark, ["A"])).collect()


def test_graph(spark):
    s = store(spark, 4, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 3, 1)])
    g = s.graph(INWeightType.Similarity)
    assert (g.n, g.m, g.total_weight) == (4, 4.0, 4.0) and g.neighbors(1) == [(0, 1.0), (2, 1.0)]
    sub, mapping = g.subgraph([2, 0, 3])
    assert {r["old_id"]: r["new_id"] for r in mapping.collect()} == {2: 0, 0: 1, 3: 2}
    assert sorted(tuple(sorted((a, b))) for a, b, _ in sub.store) == [(0, 2), (1, 2)]
    with pytest.raises(ValueError):
        g.subgraph([1, 1])
    path = store(spark, 5, [(0, 1, 0.9), (1, 2, 0.8), (2, 3, 0.6), (3, 3, 0.5)]).graph(INWeightType.Similarity)
    assert path.strength(1) == pytest.approx(1.7) and path.strength(3) == pytest.approx(1.1) and path.strength(4) == 0
    assert {r["id"]: round(r["strength"], 6) for r in path.strengths().collect()} == {0: 0.9, 1: 1.7, 2: 1.4, 3: 1.1, 4: 0.0}
    w = {k: store(spark, 2, [(0, 1, 0.25)]).graph(k).neighbors(0)[0][1] for k in INWeightType}
    assert w == {INWeightType.Similarity: 0.25, INWeightType.Distance: 0.8, INWeightType.SimilarityComplement: 0.75, INWeightType.Unweighted: 1.0}
    assert [len(r["neighbors"]) for r in path.adjacency().orderBy("id").collect()] == [1, 2, 2, 2, 0]


def test_components_match_union_find(spark):
    r = random.Random(2)
    for n, m in ((50, 30), (200, 190), (60, 0)):
        edges = [(r.randrange(n), r.randrange(n), 1) for _ in range(m)] + ([(i, i + 1, 1) for i in range(20)] if m == 30 else [])
        parent = list(range(n))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b, _ in edges:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
        seen, want = {}, {}
        for i in range(n):
            want[i] = seen.setdefault(find(i), len(seen))
        got = clusters.find_components(store(spark, n, edges).graph()) if edges else clusters.find_components(EdgeStore(n, spark.createDataFrame([], "src long, dst long, weight double")).graph())
        assert {x["id"]: x["cluster"] for x in got.collect()} == want


def test_star_forest_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(100)], "src long, dst long")
    assert {(r["node"], r["root"]) for r in star_forest(e).collect()} == {(i, 0) for i in range(101)}


def test_dense_edges_meet_as_forests(spark, monkeypatch):
    """Before, the star rounds wrote and shuffled every edge, 79,800 here, the square of a component."""
    from kinsplit.operators import components

    r = random.Random(5)
    names = [r.randrange(-(2**62), 2**62) for _ in range(400)]
    e = spark.createDataFrame([(a, b, 0.5) for i, a in enumerate(names) for b in names[:i]] + [(None, 1, 0.5), (9, 9, 0.5)], "src long, dst long, weight double").repartition(3)
    seen, signature = [], components._signature
    monkeypatch.setattr(components, "_signature", lambda x: seen.append(signature(x)) or seen[-1])
    v = spark.createDataFrame([(x,) for x in [*names, 2**62 + 1]], "id long")
    got = {x["id"]: x["cluster"] for x in clusters.find_components(EdgeStore(v, e).graph()).collect()}
    assert got == {x: int(x == 2**62 + 1) for x in [*names, 2**62 + 1]}
    assert seen[0][0] <= 3 * 399


def test_local_forests_keep_components(spark):
    from kinsplit.operators.components import _stars, local_forests

    r = random.Random(7)
    def stars(edges):
        a, b = (np.array(x, np.int64) for x in zip(*edges))
        return set(zip(*(x.tolist() for x in _stars(a, b))))

    graphs = [[(i, i + 1) for i in range(300)], [(i, 0) for i in range(300)], [(r.randrange(400), r.randrange(400)) for _ in range(350)], [(2 * i, 2 * i + 1) for i in range(200)]]
    edges = [(a + 1000 * k, b + 1000 * k) for k, g in enumerate(graphs) for a, b in g]
    r.shuffle(edges)
    whole = {(x["node"], x["root"]) for x in star_forest(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert stars(edges) == {(n, m) for n, m in whole if n != m}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for at_once in (1, 120, 100_000):
            made = [(x["src"], x["dst"]) for x in local_forests(spark.createDataFrame(edges, "u long, v long").repartition(2), "u", "v", at_once).collect()]
            assert len(made) <= len(edges) and stars(made) == stars(edges)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert local_forests(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_signature_of_many_edges(spark):
    """A sum of their hashes would not fit into a long."""
    from pyspark.sql import functions as F

    from kinsplit.operators.components import _signature

    edges = spark.range(40_000_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert _signature(edges)[0] == 40_000_000
    assert _signature(edges.where("u < 5")) != _signature(edges.where("u between 1 and 5"))


def test_partition(spark):
    edges = [(0, 1, 0.9), (1, 2, 0.8), (3, 4, 0.7), (4, 5, 0.6)]
    g = store(spark, 8, edges).graph()
    c = clusters.find_components(g)
    assert clusters.largest_cluster(c) == (0, 3) and clusters.largest_cluster(c.limit(0)) == (0, 0)
    train, test = clusters.partition(c, g, 0.3, seed=42)
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
    label = {r["id"]: r["cluster"] for r in c.collect()}
    assert a | b == set(range(8)) and not a & b and len({label[i] for i in b}) == 2 and not {label[i] for i in a} & {label[i] for i in b}
    cut = c.selectExpr("id", "id % 3 as cluster")
    train, test = clusters.partition(cut, g, 0.3, seed=1, post_filtering=True)
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
    assert not any((x in a and y in b) or (x in b and y in a) for x, y, _ in edges)
    assert clusters.test_count(0.07, 100) == 7 and math.ceil(0.07 * 100) == 8
    for bad in ((c.limit(0), 0.2), (c, 0.0), (c, 1.0), (c.where("id < 5"), 0.2)):
        with pytest.raises(ValueError):
            clusters.partition(bad[0], g, bad[1])


def test_communities(spark):
    path = store(spark, 5, [(0, 1, 0.9), (1, 2, 0.8), (2, 3, 0.6)]).graph(INWeightType.Similarity)
    assert [r["cluster"] for r in communities.find_communities(path).orderBy("id").collect()] == [0, 0, 1, 1, 2]
    r = random.Random(6)
    blocks = [(i, j, 1) for b in range(4) for i in range(b * 12, b * 12 + 12) for j in range(i + 1, b * 12 + 12) if r.random() < 0.7] + [(i * 12, ((i + 1) % 4) * 12, 1) for i in range(4)]
    g = store(spark, 48, blocks).graph(INWeightType.Similarity)
    for objective, gamma in ((LeidenObjective.Modularity, 1.0), (LeidenObjective.CPM, 0.2)):
        got = {x["id"]: x["cluster"] for x in communities.find_communities(g, gamma=gamma, objective=objective).collect()}
        assert got == {i: i // 12 for i in range(48)}
    assert communities.modularity(g, communities.find_communities(g)) > 0.5


def test_communities_of_a_giant_component(spark, monkeypatch):
    """A component over the bound of a task is condensed by rounds over tables: connected communities of like quality."""
    r = random.Random(2)
    edges = {(a, b) for g in range(8) for a in range(g * 15, g * 15 + 15) for b in range(a + 1, g * 15 + 15) if r.random() < 0.5}
    edges |= {tuple(sorted(r.sample(range(120), 2))) for _ in range(40)} | {(200, 201), (201, 202)}
    g = store(spark, 210, [(a, b, 1.0) for a, b in sorted(edges)]).graph(INWeightType.Similarity)
    plain = communities.modularity(g, communities.find_communities(g))
    monkeypatch.setattr(communities, "TASK_EDGES", 150)
    found = communities.find_communities(g)
    got = {x["id"]: x["cluster"] for x in found.collect()}
    assert len(got) == 210 and communities.modularity(g, found) > 0.95 * plain > 0.3
    near = {}
    for a, b in edges:
        if got[a] == got[b]:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    for c in set(got.values()):
        mine = [v for v in got if got[v] == c]
        seen, todo = {mine[0]}, [mine[0]]
        while todo:
            fresh = [u for u in near.get(todo.pop(), []) if u not in seen]
            seen.update(fresh)
            todo += fresh
        assert seen == set(mine)


def test_communities_of_large_ids(spark):
    edges = [(0, 1), (1, 2), (0, 2), (3, 4)]
    for base in (1, (1 << 60) + 1):
        v = spark.createDataFrame([(base + i,) for i in range(6)], "id long")
        e = spark.createDataFrame([(base + a, base + b, 1.0) for a, b in edges], "src long, dst long, weight double")
        g = EdgeStore(v, e).graph(INWeightType.Similarity)
        got = {r["id"] - base: r["cluster"] for r in communities.find_communities(g).collect()}
        assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2}


def test_numbers_follow_the_order(spark):
    from kinsplit.plans.names import free
    from kinsplit.plans.ranking import numbered

    df = spark.range(5000).selectExpr("id * 7 % 5000 as v", "id as `_at`", "id as `a.b`").repartition(9)
    got = numbered(df, "n", "v")
    assert got.columns == ["v", "_at", "a.b", "n"] and got.where("n != v").count() == 0 and got.count() == 5000
    assert numbered(df.limit(0), "n", "v").count() == 0
    assert free(df, "_AT", "x", "x") == ["_AT_1", "x", "x_1"]


def test_index(spark, tmp_path):
    r = np.random.default_rng(5)
    centres = r.normal(size=(8, 6))
    vecs = [(centres[i % 8] + 0.2 * r.normal(size=6)).tolist() for i in range(160)]
    v = items(spark, vecs, "array<double>")
    exact = {(a, b): w for a, b, w in proximity.exact_edges(KernelVariant.TanimotoReal, v, 0.4)}
    for rows in (1000, 60):
        state = HNSWState(KernelVariant.TanimotoReal, v, config=HNSWConfig(proximity_threshold=0.4), shard_rows=rows)
        assert not state.is_built
        with pytest.raises(RuntimeError):
            state.search(v)
        state.build()
        with pytest.raises(RuntimeError):
            state.build()
        got = {(a, b): w for a, b, w in state.edges()}
        assert all(exact[k] == pytest.approx(w) for k, w in got.items()) and len(got) >= 0.95 * len(exact)
        near = state.search(v, k=3).collect()
        assert len(near) == 480 and sum(x["rank"] == 1 and x["ref_id"] == x["query_id"] for x in near) >= 155
        with pytest.raises(IndexError):
            state.get_layer(99)
        assert state.get_layer(0).count() == 160 and "HNSWIndex(dataset_size=160" in str(state.index)
        state.save(str(tmp_path / f"i{rows}"))
        back = HNSWState.load(KernelVariant.TanimotoReal, str(tmp_path / f"i{rows}"), v)
        assert sorted(map(tuple, back.search(v, k=3).collect())) == sorted(map(tuple, near))
    with pytest.raises(RuntimeError):
        HNSWState.load(KernelVariant.TanimotoReal, str(tmp_path / "i60"), v.limit(3))
    with pytest.raises(RuntimeError):
        HNSWIndex.load(str(tmp_path / "none"), spark)
    few = HNSWState(KernelVariant.AlignmentGlobal, items(spark, SEQS), config=HNSWConfig(keep_all_edges=False, extend_candidates=True, threshold_based_neighbourhood=True, shuffle=True)).build()
    assert few.edges() is None and few.search(items(spark, SEQS[:1]), k=2).first()["distance"] == 0.0
    empty = HNSWState(KernelVariant.AlignmentGlobal, items(spark, SEQS).limit(0)).build()
    assert empty.search(items(spark, SEQS)).count() == 0 and len(empty.edges()) == 0


def test_index_of_several_shards_is_one_index(spark):
    """Layers follow the number of all items, and a search has one entry, however many shards there are."""
    from kinsplit.operators.ann import max_layers

    v = items(spark, np.random.default_rng(8).normal(size=(90, 4)).tolist(), "array<double>")
    state = HNSWState(KernelVariant.TanimotoReal, v, config=HNSWConfig(proximity_threshold=0.5), shard_rows=20).build()
    index = state.index
    assert index.shards == 5 and index.shard_entries.count() == 5 and len(index.entry_point) == 1
    assert index.max_layers == len(index.layers) == max_layers(90, index.config.m_l)
    assert index.entry_point[0][1] == max(r["layer"] for r in index.shard_entries.collect())
    assert state.get_layer(0).where("size(neighbors) > 0").count() == 90 and state.get_layer(index.max_layers - 1).count() == 90
    assert state.search(v, 1).where("query_id = ref_id").count() >= 81


def test_index_keeps_dense_groups_across_shards(spark):
    """A group far larger than ef_construction, dealt over shards."""
    r = np.random.default_rng(6)
    vecs = (np.ones(6) + 0.05 * r.normal(size=(240, 6))).tolist() + (np.array([1, -1, 1, -1, 1, -1]) + 0.05 * r.normal(size=(20, 6))).tolist()
    v = items(spark, vecs, "array<double>")
    exact = {(a, b): w for a, b, w in proximity.exact_edges(KernelVariant.TanimotoReal, v, 0.4)}
    config = HNSWConfig(proximity_threshold=0.4, ef_construction=16)
    for rows in (1000, 90):
        state = HNSWState(KernelVariant.TanimotoReal, v, config=config, shard_rows=rows).build()
        assert state.shards == (1 if rows == 1000 else 3)
        got = {(a, b): w for a, b, w in state.edges()}
        assert all(exact[k] == pytest.approx(w) for k, w in got.items()) and len(got) >= 0.95 * len(exact)
        assert state.search(v, k=3).count() == 3 * len(vecs)


def test_walks_go_on_side_by_side():
    """Queries of a graph walk together, a few products a round, and find what brute force does."""
    from kinsplit.operators.ann import Graph

    class Counted(TanimotoReal):
        calls = 0

        def pairs(self, *a):
            Counted.calls += 1
            return super().pairs(*a)

        def block(self, *a):
            Counted.calls += 1
            return super().block(*a)

    r = np.random.default_rng(9)
    x, q = r.normal(size=(300, 6)), r.normal(size=(200, 6))
    graph, plain = Graph(list(range(300)), x.tolist(), Counted(), HNSWConfig(proximity_threshold=0.5)).build(), TanimotoReal()
    d = plain.block(x, q)
    Counted.calls = 0
    at, ref, dist = graph.walks(q, None, 64)
    assert np.allclose(d[ref, at], dist) and len(set(zip(at, ref))) == len(at) >= 0.95 * (d < 0.5).sum() and (dist < 0.5).all()
    at, ref, dist = graph.walks(q, 3, 64)
    assert np.allclose(d[ref, at], dist) and np.bincount(at).tolist() == [3] * 200
    assert sum(set(ref[at == i]) == set(np.argsort(d[:, i])[:3]) for i in range(200)) >= 190
    assert Counted.calls < 2 * 200


def test_edge_files(spark, tmp_path):
    s = store(spark, 6, [(0, 1, 0.5), (2, 3, 0.25)])
    for name in ("e.edgelist", "e.edgestr", "e.parquet"):
        s.save(str(tmp_path / name))
        back = EdgeStore.load(str(tmp_path / name), spark)
        assert back.node_count == 6 and list(back) == [(0, 1, 0.5), (2, 3, 0.25)]
    assert (tmp_path / "e.edgelist").read_text().startswith("# n = 6\n0 1 0.5\n")
    with pytest.raises(OSError):
        s.save(str(tmp_path / "e.txt"))
    (tmp_path / "bad.edgelist").write_text("0 1 1\n")
    (tmp_path / "worse.edgelist").write_text("# n = 3\n0 x 1\n")
    (tmp_path / "cut.edgestr").write_bytes((tmp_path / "e.edgestr").read_bytes()[:-3])
    for name in ("bad.edgelist", "worse.edgelist", "cut.edgestr", "none.edgelist", "none.parquet"):
        with pytest.raises(OSError):
            EdgeStore.load(str(tmp_path / name), spark)


def test_edge_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """In order over several parts, every byte as it is, with no row on the driver and no task that sorts all edges."""
    from pyspark.sql import DataFrame

    from kinsplit.sources import edgelist

    def refused(*args, **kwargs):
        raise AssertionError("rows come to one place")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    real = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda df, n, *c: refused() if n == 1 else real(df, n, *c))
    monkeypatch.setattr(edgelist, "PART_RECORDS", 300)
    r = random.Random(4)
    edges = sorted({(a, b): r.random() for a, b in ((r.randrange(3000), r.randrange(3000)) for _ in range(2500))}.items())
    s = store(spark, 3000, [(a, b, w) for (a, b), w in edges])
    for name in ("a.edgestr", "a.edgelist"):
        s.save(str(tmp_path / name))
    raw = np.frombuffer((tmp_path / "a.edgestr").read_bytes()[edgelist._HEAD.size :], edgelist._RECORD)
    assert [(x["src"], x["dst"], x["weight"]) for x in raw] == [(a, b, np.float32(w)) for (a, b), w in edges]
    lines = (tmp_path / "a.edgelist").read_text().splitlines()
    assert lines[0] == "# n = 3000" and [tuple(map(float, x.split())) for x in lines[1:]] == [(a, b, w) for (a, b), w in edges]
    assert EdgeStore.load(str(tmp_path / "a.edgestr"), spark).edges.count() == len(edges)


def test_degrees(spark):
    g = store(spark, 5, [(0, 1, 0.5), (1, 2, 0.5), (2, 2, 0.1), (0, 1, 0.3)]).graph()
    lists = {r["id"]: len(r["neighbors"]) for r in g.adjacency().collect()}
    assert {r["id"]: r["degree"] for r in g.degrees().collect()} == lists == {0: 2, 1: 3, 2: 2, 3: 0, 4: 0}


def test_sequence_and_molecule_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("x\n>seq1 first\nACDE\nFGHI\n\n>seq2\n PQRS \n")
    assert [tuple(r) for r in sequences.read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("id").collect()] == [(0, "seq1 first", "ACDEFGHI"), (1, "seq2", "PQRS")]
    (tmp_path / "m.smi").write_text("# c\nc1ccccc1 benzene\n\nCCO\n")
    (tmp_path / "m.csv").write_text("id,Smiles\nx,CCO\ny,O\n")
    (tmp_path / "m.sdf").write_text("one\nM  END\n$$$$\ntwo\nM  END\n$$$$\n")
    read = lambda n: [tuple(r) for r in sequences.read_molecule_file(spark, str(tmp_path / n)).orderBy("id").collect()]
    assert read("m.smi") == [(0, "benzene", "c1ccccc1"), (1, "3", "CCO")] and read("m.csv") == [(0, "x", "CCO"), (1, "y", "O")]
    assert [r[:2] for r in read("m.sdf")] == [(0, "0"), (1, "1")]
    for bad in ("m.txt", "none.smi"):
        with pytest.raises(OSError):
            read(bad)
    prints = sequences.text_fingerprints(sequences.read_smi(spark, str(tmp_path / "m.smi")), "smiles")
    assert all(len(r["item"]) >= 1 for r in prints.collect())


def test_line_files_are_read_in_splits(spark, tmp_path, monkeypatch):
    """Records cross splits, and files of several splits follow one another."""
    from kinsplit.sources import edgelist

    r = random.Random(6)
    want, n = [], 0
    for name in ("a.fasta", "b.fasta"):
        text = "lost\n"
        for _ in range(60):
            seq = ["".join(r.choice("ACDEFGHIKL") for _ in range(r.randint(1, 70))) for _ in range(r.randint(0, 9))]
            text += f">seq {n}\n" + "".join(x + r.choice(["\n", "\r\n", "\n\n"]) for x in seq)
            want.append((n, f"seq {n}", "".join(seq)))
            n += 1
        (tmp_path / name).write_text(text)
    molecules = [f"mol {i}\n" + "line\n" * r.randint(1, 30) + "M  END\n" for i in range(50)]
    (tmp_path / "m.sdf").write_text("$$$$\n".join(molecules) + "$$$$\n")
    edges = [(i, i + 1, i / 4) for i in range(1000)]
    store(spark, 1001, edges).save(str(tmp_path / "e.edgestr"))
    monkeypatch.setattr(edgelist, "PIECE", 12 * 70)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert [tuple(x) for x in sequences.read_fasta(spark, str(tmp_path / "*.fasta")).orderBy("id").collect()] == want
        assert [tuple(x) for x in sequences.read_sdf(spark, str(tmp_path / "m.sdf")).orderBy("id").collect()] == [(i, str(i), m) for i, m in enumerate(molecules)]
        back = EdgeStore.load(str(tmp_path / "e.edgestr"), spark)
        assert back.node_count == 1001 and list(back) == edges
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def pdb(path, xyz):
    path.write_text("".join(f"ATOM  {i:5d}  CA  ALA A{i:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           C\n" for i, (x, y, z) in enumerate(xyz, 1)))
    return str(path)


def test_structures(spark, tmp_path):
    t = np.arange(60)
    helix = np.stack([2.3 * np.cos(1.745 * t), 2.3 * np.sin(1.745 * t), 1.5 * t], axis=1)
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    other = np.cumsum(np.random.default_rng(3).normal(size=(60, 3)) * 2.2, axis=0)
    a, b, c = (PdbStructure(pdb(tmp_path / n, x)) for n, x in (("a.pdb", helix), ("b.pdb", helix[:45] @ turn + 5), ("c.pdb", other)))
    k = USAlignKernel()
    assert a.seq == "A" * 60 and k(a, a) == pytest.approx(0, abs=1e-6)
    assert USAlignKernel(norm_mode=NormMode.Query)(a, b) < 0.05 and k(a, b) == pytest.approx(0.25, abs=0.05) and k(a, c) > 0.5
    with pytest.raises(RuntimeError):
        PdbStructure(pdb(tmp_path / "d.pdb", helix[:2]))
    with pytest.raises(RuntimeError):
        PdbStructure(str(tmp_path / "none.pdb"))
    rows = sequences.read_pdb(spark, str(tmp_path / "[abc].pdb"))
    e = proximity.exact_edges(KernelVariant.Structure, rows.select("id", "item"), 0.4)
    assert [(x, y) for x, y, _ in e] == [(0, 1)]


def test_config():
    c = HNSWConfig()
    assert len(c.dict()) == 17 and c.ef_construction == 64 and str(c).startswith("HNSWConfig(proximity_threshold=0.5")
    assert len(ScoringMatrix) == 69 and len(KernelVariant) == 5


def test_public_names():
    import kinsplit
    from kinsplit import core, kernels, utils
    from kinsplit.kernels import alignments, molecules, structures

    for module in (core, kernels, utils, alignments, molecules, structures):
        assert all(hasattr(module, n) for n in module.__all__)
    for name in ("KernelVariant", "HNSWState", "LeidenObjective", "find_communities", "find_components", "partition", "exact_edges", "exact_nearest_neighbors"):
        assert hasattr(kinsplit, name)


def test_incremental_edges(spark):
    from kinsplit.streaming.incremental import new_edges

    v = items(spark, SEQS)
    got = new_edges(KernelVariant.AlignmentGlobal, v.where("id < 3"), v.where("id >= 3"), 0.5)
    assert sorted((r["src"], r["dst"]) for r in got.collect()) == [(0, 3), (2, 3)]


def test_incremental_edges_are_found_in_one_pass(spark, monkeypatch):
    """Known pairs are left out where they are found; the edges are not computed once for each end."""
    from kinsplit.streaming.incremental import new_edges

    r = np.random.default_rng(2)
    monkeypatch.setattr(TanimotoReal, "rows_per_block", 9)
    vecs = r.normal(size=(50, 3)).tolist()
    bits = [sorted(set(r.integers(0, 12, 7).tolist())) for _ in range(50)]
    for kernel, values, kind in ((KernelVariant.TanimotoReal, vecs, "array<double>"), (KernelVariant.TanimotoBit, bits, "array<int>")):
        v = items(spark, values, kind)
        got = new_edges(kernel, v.where("id % 3 = 0"), v.where("id % 3 > 0"), 0.6)
        want = {e for e in proximity.exact_edges(kernel, v, 0.6) if e[0] % 3 or e[1] % 3}
        assert {tuple(e) for e in got.collect()} == want and got.count() == len(want)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") <= 1
