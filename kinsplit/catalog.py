"""Registered queries of the core library, each over its whole tables, and their SQL equivalents."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsplit.config import CoverageMode, GlobalIdentityMode, HNSWConfig, INWeightType, KernelVariant, ScoringMatrix
from kinsplit.functions import fingerprints as fp
from kinsplit.functions.alignment import GlobalAligner
from kinsplit.functions.kernels import TanimotoBit, TanimotoReal, make_kernel
from kinsplit.functions.matrices import matrix_table
from kinsplit.operators import clusters, communities, proximity
from kinsplit.operators.ann import HNSWState
from kinsplit.operators.edges import EdgeStore
from kinsplit.plans.ranking import numbered
from kinsplit.plans.storage import forget_at_exit, materialize, shared_dir

NEAR, KNN = 0.8, 5
ALIKE = 0.5  # of token sets


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, d) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("item"))


def _token_sets(spark, d) -> DataFrame:
    words = F.array_distinct(F.split(F.coalesce("text", F.lit("")), " "))
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.transform(words, lambda w: F.xxhash64(w)).alias("item"))


def _names(spark, d) -> DataFrame:
    names = _table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return names.select("id", F.upper("p_name").alias("item"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _store(spark, d) -> EdgeStore:
    return proximity.exact_edges(KernelVariant.TanimotoReal, _vectors(spark, d), NEAR)


def _saved(store: EdgeStore) -> EdgeStore:
    return EdgeStore(store.vertices, materialize(store.edges, "edges"))


# ---- distances, edges, neighbours


def tanimoto_real_zip(spark, d):
    v = _vectors(spark, d)
    after = v.select((F.col("id") - 1).alias("id"), "item")
    return _rounded(proximity.zip_kernel(KernelVariant.TanimotoReal, v.join(after.select("id"), "id", "left_semi"), after.join(v.select("id"), "id", "left_semi")), "distance")


def tanimoto_real_edges(spark, d):
    return _rounded(_store(spark, d).edges, "weight")


def tanimoto_real_knn(spark, d):
    v = _vectors(spark, d)
    return _rounded(proximity.exact_nearest_neighbors(KernelVariant.TanimotoReal, v, v, KNN), "distance")


def tanimoto_bit_zip(spark, d):
    v = _token_sets(spark, d)
    after = v.select((F.col("id") - 1).alias("id"), "item")
    return _rounded(proximity.zip_kernel(KernelVariant.TanimotoBit, v.join(after.select("id"), "id", "left_semi"), after.join(v.select("id"), "id", "left_semi")), "distance")


def tanimoto_bit_edges(spark, d):
    return _rounded(proximity.exact_edges(KernelVariant.TanimotoBit, _token_sets(spark, d), ALIKE).edges, "weight")


def tanimoto_bit_knn(spark, d):
    items = _table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.transform(F.array_distinct(F.split("text", " ")), lambda w: F.xxhash64(w)).alias("item"))
    return _rounded(proximity.exact_nearest_neighbors(KernelVariant.TanimotoBit, items, _token_sets(spark, d), KNN), "distance")


def bit_fingerprint(spark, d):
    """Packed words of word lengths modulo 256, and their popcount."""
    lengths = F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w) % 256))
    return _table(spark, d, "documents").select("doc_id", fp.popcount(fp.packed(lengths, 256)).cast("long").alias("n_on"))


def global_align_edges(spark, d):
    return _rounded(proximity.exact_edges(KernelVariant.AlignmentGlobal, _names(spark, d), 0.6).edges, "weight")


def global_align_pruned(spark, d):
    """Pairs of names to decide, and edges that pruning by length loses or adds (none)."""
    class Unpruned(type(make_kernel(KernelVariant.AlignmentGlobal))):
        def bound(self, small, large):
            return 1.0

    names = materialize(_names(spark, d), "names")
    plain = proximity.exact_edges(Unpruned(GlobalAligner()), names, 0.6).edges
    pruned = proximity.exact_edges(KernelVariant.AlignmentGlobal, names, 0.6).edges
    n = names.count()
    lost, added = plain.exceptAll(pruned).count(), pruned.exceptAll(plain).count()
    return spark.createDataFrame([(n, proximity.exact_edges_total(n), lost, added)], "names long, pairs long, lost long, added long")


def global_align_knn(spark, d):
    v = _names(spark, d)
    return _rounded(proximity.exact_nearest_neighbors(KernelVariant.AlignmentGlobal, v, v, 3), "distance")


def global_align_zip(spark, d):
    p = _table(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("item"))
    b = p.select(F.col("p_partkey").alias("id"), F.upper("p_type").alias("item"))
    return _rounded(proximity.zip_kernel(KernelVariant.AlignmentGlobal, a, b), "distance")


def local_align_edges(spark, d):
    return _rounded(proximity.exact_edges(KernelVariant.AlignmentLocal, _names(spark, d), 0.6, min_coverage=0.5).edges, "weight")


# ---- graphs


def graph_summary(spark, d):
    g = _saved(_store(spark, d)).graph(INWeightType.SimilarityComplement)
    return spark.createDataFrame([(g.n, len(g.store), round(g.m, 4), round(g.total_weight, 4))], "n long, edges long, m double, total_weight double")


def weight_mapping(spark, d):
    e = _store(spark, d).edges
    from kinsplit.operators.graph import similarity

    return e.select("src", "dst", *[F.round(similarity(F.col("weight"), k), 6).alias(k.value) for k in INWeightType])


def neighbors(spark, d):
    return _rounded(_saved(_store(spark, d)).graph(INWeightType.Distance).sym, "w")


def strength(spark, d):
    return _rounded(_saved(_store(spark, d)).graph(INWeightType.Distance).strengths(), "strength")


def supply_strength(spark, d):
    """Parts and suppliers as one graph, an edge for each line of an order; suppliers have negative ids."""
    li = _table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"), F.col("l_quantity").alias("weight"))
    nodes = _table(spark, d, "part").select(F.col("p_partkey").alias("id")).unionByName(_table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("id")))
    return _rounded(EdgeStore(nodes, li).graph(INWeightType.Similarity).strengths(), "strength")


def _kept(spark, d) -> DataFrame:
    return numbered(_table(spark, d, "embeddings").where("label <= 2").select(F.col("vec_id").alias("old_id")), "new_id", "old_id")


def subgraph(spark, d):
    g, _ = _saved(_store(spark, d)).graph(INWeightType.SimilarityComplement).subgraph(_kept(spark, d))
    return _rounded(g.store.edges, "weight")


def subgraph_mapping(spark, d):
    return _saved(_store(spark, d)).graph().subgraph(_kept(spark, d))[1]


def degree(spark, d):
    """Neighbours of every vertex, as many as its list holds."""
    return _saved(_store(spark, d)).graph().degrees()


# ---- clusters


def components(spark, d):
    return clusters.find_components(_store(spark, d).graph())


def component_sizes(spark, d):
    return components(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def order_components(spark, d):
    """Components of customers and their orders: one for each customer with orders."""
    o = _table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (-F.col("o_orderkey") - 1).alias("dst"), F.lit(1.0).alias("weight"))
    nodes = o.select(F.col("src").alias("id")).unionByName(o.select(F.col("dst").alias("id"))).distinct()
    c = clusters.find_components(EdgeStore(nodes, o).graph(INWeightType.Similarity))
    return c.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


def largest_cluster(spark, d):
    return spark.createDataFrame([clusters.largest_cluster(components(spark, d))], "cluster long, size long")


def _split(spark, d, filtered):
    store = _store(spark, d)
    g = (_saved(store) if filtered else store).graph()  # else the edges are read once
    if filtered:  # labels cut through the graph, so there is something to filter
        c = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cluster"))
    else:
        c = materialize(clusters.find_components(g), "clusters")
    train, test = clusters.partition(c, g, 0.3, 42, filtered)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


def partition(spark, d):
    return _split(spark, d, False)


def partition_filtered(spark, d):
    return _split(spark, d, True)


def communities_invariants(spark, d):
    """Communities that span components (none), the modularity of components, and whether that of communities is no less."""
    g = _saved(_store(spark, d)).graph(INWeightType.SimilarityComplement)
    comp, com = materialize(clusters.find_components(g), "components"), materialize(communities.find_communities(g, n_iterations=0), "communities")
    crossing = com.join(comp.withColumnRenamed("cluster", "component"), "id").groupBy("cluster").agg(F.countDistinct("component").alias("n")).where("n > 1").count()
    q, base = communities.modularity(g, com), communities.modularity(g, comp)
    single = communities.modularity(g, g.vertices.withColumn("cluster", F.col("id")))
    row = (crossing, com.count(), round(base, 6), round(single, 6), q >= max(base, single) - 1e-9)
    return spark.createDataFrame([row], "crossing long, vertices long, components_modularity double, singletons_modularity double, no_less boolean")


# ---- approximate index


def _index(spark, d) -> HNSWState:
    return HNSWState(KernelVariant.TanimotoReal, _vectors(spark, d), config=HNSWConfig(proximity_threshold=NEAR)).build()


def ann_quality(spark, d):
    """Exact edges, edges of the index that those lack or differ from (none), and whether it finds nine tenths of edges and neighbours."""
    v, state = _vectors(spark, d), _index(spark, d)
    exact, found = materialize(_store(spark, d).edges, "exact"), state.edges().edges
    right = found.withColumnRenamed("weight", "w").join(exact, ["src", "dst"]).where("abs(w - weight) < 1e-9").count()
    n, m = found.count(), exact.count()
    near = state.search(v, KNN).select("query_id", "ref_id")
    true = proximity.exact_nearest_neighbors(KernelVariant.TanimotoReal, v, v, KNN).select("query_id", "ref_id")
    hits, all_ = near.join(true, ["query_id", "ref_id"]).count(), true.count()
    return spark.createDataFrame([(m, all_, n - right, right >= 0.9 * m, hits >= 0.9 * all_)], "exact_edges long, exact_neighbors long, wrong long, edge_recall boolean, neighbor_recall boolean")


def index_fields(spark, d):
    """Size, layers and shape of an index: every item has a list in the lowest layer, and no list names its own item."""
    state = _index(spark, d)
    index, low = state.index, state.get_layer(0)
    own = low.where(F.array_contains("neighbors", F.col("id"))).count()
    return spark.createDataFrame([(index.dataset_size, index.max_layers, len(index.layers), low.count(), own, state.is_built, len(index.entry_point))], "dataset_size long, max_layers long, layers long, in_lowest long, own long, is_built boolean, entries long")


def index_save_load(spark, d):
    """A saved index, loaded again: its fields, and whether it has the same edges and finds the same neighbours."""
    path, v, state = f"{shared_dir(spark)}/kinsplit/index-{uuid.uuid4().hex}", _vectors(spark, d), _index(spark, d)
    forget_at_exit(spark, path)
    state.save(path)
    back = HNSWState.load(KernelVariant.TanimotoReal, path, v)
    edges = [s.edges().edges.agg(F.count(F.lit(1)), F.round(F.sum("weight"), 6)).first() for s in (state, back)]
    few = v.where("id < 20")
    found = [sorted(map(tuple, s.search(few, 3).select("query_id", "rank", "ref_id").collect())) for s in (state, back)]
    return spark.createDataFrame([(back.index.dataset_size, edges[0] == edges[1], found[0] == found[1], len(found[1]))], "dataset_size long, same_edges boolean, same_neighbors boolean, found long")


def incremental_edges(spark, d):
    """Edges that the vectors with odd ids bring to those with even ones."""
    from kinsplit.streaming.incremental import new_edges

    v = _vectors(spark, d)
    return _rounded(new_edges(KernelVariant.TanimotoReal, v.where("id % 2 = 0"), v.where("id % 2 = 1"), NEAR), "weight")


# ---- published fixtures: sequences and structures whose distances are known

# Sequences of the public tests.
F1 = ["ACDEFGHIKLMNPQRSTVWY", "ACDAFGHKILMNPQRSTVWY", "ACDEFGHIPLMNPQRSTVWY", "ACDEFGHIKLMIJKPPWY", "GGLLPLPKLMNKKKSTVGG"]
F3 = [("AEP", "PPP"), ("PEA", "AEA"), ("ACDEFGHIKLM", "ACDEFGHIKLM")]


def _literal(spark, values) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "id long, item string")


def global_align_fixture(spark, d):
    return proximity.exact_edges(KernelVariant.AlignmentGlobal, _literal(spark, F1), 0.8).edges.withColumn("weight", F.round("weight", 4))


def global_align_threshold(spark, d):
    """The pair at exactly the threshold is no edge."""
    return proximity.exact_edges(KernelVariant.AlignmentGlobal, _literal(spark, F1), 0.5).edges.select("src", "dst")


def global_align_fixture_knn(spark, d):
    v = _literal(spark, F1)
    return proximity.exact_nearest_neighbors(KernelVariant.AlignmentGlobal, v.where("id > 2"), v.where("id <= 2"), 2).withColumn("distance", F.round("distance", 4))


def global_align_fixture_zip(spark, d):
    a, b = (_literal(spark, [p[i] for p in F3]) for i in (0, 1))
    return proximity.zip_kernel(KernelVariant.AlignmentGlobal, a, b).withColumn("distance", F.round("distance", 4))


def _modes(spark, kernel, modes, pairs, **options) -> DataFrame:
    """(mode, id, distance) of zipped pairs under each mode."""
    a, b = (_literal(spark, [p[i] for p in pairs]) for i in (0, 1))
    out = None
    for name, mode in modes:
        one = proximity.zip_kernel(kernel, a, b, **mode, **options).select(F.lit(name).alias("mode"), "id", F.round("distance", 4).alias("distance"))
        out = one if out is None else out.unionByName(one)
    return out


def global_identity_modes(spark, d):
    pairs = [("MKTAYIAK", "MKTAYIAKQR"), ("AAAA", "AAAA"), ("ACDE", "ACE")]
    return _modes(spark, KernelVariant.AlignmentGlobal, [(m.name, {"identity_mode": m}) for m in GlobalIdentityMode], pairs)


def local_coverage_modes(spark, d):
    """A whole sequence inside a longer one: which coverage lets it pass."""
    pairs = [("GGGMKTAYIAKGGG", "MKTAYIAK"), ("MKTAYIAK", "MKTAYIAK"), ("MKTAYIAK", "GGGMKTAYIAKGGG")]
    return _modes(spark, KernelVariant.AlignmentLocal, [(m.name, {"cov_mode": m}) for m in CoverageMode], pairs, min_coverage=0.8)


def _pdb(xyz) -> str:
    return "".join(f"ATOM  {i:5d}  CA  ALA A{i:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           C\n" for i, (x, y, z) in enumerate(xyz, 1))


def structure_distance(spark, d):
    """A helix against itself, moved and turned: distance 0."""
    helix = [(2.3 * math.cos(1.745 * i), 2.3 * math.sin(1.745 * i), 1.5 * i) for i in range(40)]
    moved = [(z + 5, x - 3, y + 1) for x, y, z in helix]
    a, b = _literal(spark, [_pdb(helix), _pdb(helix)]), _literal(spark, [_pdb(helix), _pdb(moved)])
    return proximity.zip_kernel(KernelVariant.Structure, a, b).select("id", (F.round("distance", 3) + 0.0).alias("distance"))


def fingerprint_objects(spark, d):
    """Lengths, counts and norms of fingerprints made from lists and arrays, and two distances of the documentation."""
    bits = [True, False, True, True, False]
    b, r = fp.BitFingerprint(bits), fp.RealFingerprint([1.0, 0.0, 2.0])
    same = fp.BitFingerprint.from_np(b.to_np()).to_list() == bits and list(fp.RealFingerprint.from_np(r.to_np()).to_list()) == [1.0, 0.0, 2.0]
    tb = TanimotoBit()(fp.BitFingerprint([True, False, True, True]), fp.BitFingerprint([True, True, True, False]))
    tr = TanimotoReal()(fp.RealFingerprint([1.0, 0.0, 1.0]), fp.RealFingerprint([0.0, 1.0, 1.0]))
    return spark.createDataFrame([(len(b), b.count(), float(r.norm_sq()), same, round(tb, 4), round(tr, 4))], "length long, on_bits long, norm_sq double, round_trip boolean, bit_distance double, real_distance double")


# ---- files


def _file(spark: SparkSession, lines: list[str], name: str) -> str:
    path = f"{shared_dir(spark)}/kinsplit/files-{uuid.uuid4().hex}/{name}"
    spark.createDataFrame([("\n".join(lines),)], "t string").coalesce(1).write.text(path)
    return path + "/part-*"


def fasta_read(spark, d):
    from kinsplit.sources.sequences import read_fasta

    return read_fasta(spark, _file(spark, ["lost", ">seq1 first protein", "ACDE", " FGHI ", "", ">seq2", "PQRS", "TVWY", ">empty"], "fasta"))


def smi_read(spark, d):
    from kinsplit.sources.sequences import read_smi

    return read_smi(spark, _file(spark, ["# molecules", "c1ccccc1 benzene", "", "CC(=O)O", "CCO ethyl alcohol"], "smi"))


def csv_mol_read(spark, d):
    from kinsplit.sources.sequences import read_csv_mol

    return read_csv_mol(spark, _file(spark, ["Name,mass,SMILES", "benzene,78,c1ccccc1", "water,18,O"], "csv"))


def edgelist_round_trip(spark, d):
    path = f"{shared_dir(spark)}/kinsplit/files-{uuid.uuid4().hex}.edgelist"
    forget_at_exit(spark, path)
    _saved(_store(spark, d)).save(path)  # the sort by range reads its edges twice
    return _rounded(EdgeStore.load(path, spark).edges, "weight")


def edge_table_round_trip(spark, d):
    path = f"{shared_dir(spark)}/kinsplit/files-{uuid.uuid4().hex}.parquet"
    _store(spark, d).save(path)
    back = EdgeStore.load(path, spark)
    return _rounded(back.edges, "weight")


def edge_records_round_trip(spark, d):
    """Binary records hold single precision."""
    path = f"{shared_dir(spark)}/kinsplit/files-{uuid.uuid4().hex}.edgestr"
    forget_at_exit(spark, path)
    store = _saved(_store(spark, d))
    store.save(path)
    back = EdgeStore.load(path, spark)
    return back.edges.select("src", "dst", F.round("weight", 4).alias("weight"), F.lit(back.node_count).cast("long").alias("nodes"))


def sdf_read(spark, d):
    from kinsplit.sources.sequences import read_sdf

    return read_sdf(spark, _file(spark, ["one", "M  END", "$$$$", "two", "", "M  END", "$$$$", ""], "sdf"))


def molecule_file_read(spark, d):
    """By extension, and hashed n-grams of the strings."""
    from kinsplit.sources.sequences import read_molecule_file, text_fingerprints

    path = f"{shared_dir(spark)}/kinsplit/files-{uuid.uuid4().hex}.smi"
    forget_at_exit(spark, path)
    spark.createDataFrame([("c1ccccc1 benzene\nCCO\nCC",)], "t string").coalesce(1).write.text(path)
    return text_fingerprints(read_molecule_file(spark, path), "smiles").select("id", "label", "smiles", F.size("item").cast("long").alias("on_bits"))


def pdb_read(spark, d):
    from kinsplit.functions.structure import parse_pdb
    from kinsplit.sources.sequences import read_pdb

    lines = _pdb([(1.0, 2.0, 3.0), (4.5, -5.0, 6.25)]).splitlines()
    read = read_pdb(spark, _file(spark, [*lines, "END"], "pdb"))
    xyz = [(r["id"], *map(float, p)) for r in read.collect() for p in parse_pdb(r["item"])[1]]
    return spark.createDataFrame(xyz, "id long, x double, y double, z double")


def queries() -> dict:
    fs = [tanimoto_real_zip, tanimoto_real_edges, tanimoto_real_knn, tanimoto_bit_zip, tanimoto_bit_edges, tanimoto_bit_knn, bit_fingerprint, global_align_edges, global_align_pruned, global_align_knn, global_align_zip, local_align_edges, global_align_fixture, global_align_threshold, global_align_fixture_knn, global_align_fixture_zip, global_identity_modes, local_coverage_modes, structure_distance, fingerprint_objects, graph_summary, weight_mapping, neighbors, strength, supply_strength, degree, subgraph, subgraph_mapping, components, component_sizes, order_components, largest_cluster, partition, partition_filtered, communities_invariants, ann_quality, index_fields, index_save_load, incremental_edges, fasta_read, smi_read, csv_mol_read, sdf_read, molecule_file_read, pdb_read, edgelist_round_trip, edge_table_round_trip, edge_records_round_trip]
    return {f.__name__: f for f in fs}


# ---- SQL

_V = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS q FROM embeddings)"
_P = f"{_V}, p AS (SELECT a.id AS src, b.id AS dst, a.q + b.q AS qq, list_dot_product(a.x, b.x) AS xy FROM v a CROSS JOIN v b)"
_D = "CASE WHEN qq - xy = 0 THEN 0 ELSE 1 - xy / (qq - xy) END"
_E = f"{_P}, e AS (SELECT src, dst, {_D} AS weight FROM p WHERE src < dst AND {_D} < {NEAR})"
_T = "t AS (SELECT doc_id AS id, unnest(list_distinct(string_split(coalesce(text, ''), ' '))) AS w FROM documents), n AS (SELECT id, count(*) AS n FROM t GROUP BY id)"
_C = f"WITH RECURSIVE {_E}, s AS (SELECT src AS v, dst AS u FROM e UNION ALL SELECT dst, src FROM e), r(id, root) AS (SELECT id, id FROM v UNION SELECT s.u, r.root FROM r JOIN s ON s.v = r.id WHERE r.root < s.u), c0 AS (SELECT id, min(root) AS root FROM r GROUP BY id), c AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM c0)"


def _split_sql(cluster: str, filtered: bool) -> str:
    train = "SELECT id, 'train' AS side FROM k WHERE cluster NOT IN (SELECT cluster FROM chosen)"
    if filtered:
        train += " AND id NOT IN (SELECT s.v FROM s JOIN k ON k.id = s.u WHERE k.cluster IN (SELECT cluster FROM chosen))"
    return f"{_C}, k AS ({cluster}), m AS (SELECT DISTINCT cluster FROM k), ranked AS (SELECT cluster, row_number() OVER (ORDER BY md5('42:' || cluster), cluster) AS r FROM m), chosen AS (SELECT cluster FROM ranked WHERE r <= (SELECT ceil(CAST(0.3 AS FLOAT) * CAST(count(*) AS FLOAT)) FROM m)) {train} UNION ALL SELECT id, 'test' FROM k WHERE cluster IN (SELECT cluster FROM chosen)"


def _align_sql(pairs: str, local: bool) -> str:
    """Common table expressions up to ``found`` (id, matches, length) of the alignments of ``pairs`` (id, a, b), a cell a row, diagonal by diagonal.

    A cell gets its upper neighbour's gap in b, its left one's gap in a, and the upper one's left neighbour as diagonal.
    """
    table, letters = matrix_table(ScoringMatrix.Blosum62), "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789#&-"
    scores = ", ".join(f"('{x}{y}', {int(table[ord(x), ord(y)])})" for x in letters for y in letters)
    low, h = -100000000, ("hs", "hm", "hl")

    def gap(side: str, kind: str) -> str:
        opened = f"{side}hs - 11 >= {side}{kind}s - 1"
        return f"CASE WHEN {opened} THEN {side}hs - 11 ELSE {side}{kind}s - 1 END AS {kind}s, CASE WHEN {opened} THEN {side}hm ELSE {side}{kind}m END AS {kind}m, CASE WHEN {opened} THEN {side}hl ELSE {side}{kind}l END + 1 AS {kind}l"

    got = ", ".join(f"max({c}) FILTER (src = '{side}') AS {side}{c}" for side, cs in (("u", (*h, "fs", "fm", "fl", "ls", "lm", "ll")), ("l", (*h, "es", "em", "el"))) for c in cs)
    kind = "CASE WHEN i = 0 THEN 'e' WHEN j = 0 THEN 'f' WHEN es > greatest(ds, fs) THEN 'e' WHEN fs > ds THEN 'f' ELSE 'd' END"
    value = lambda c: f"CASE k WHEN 'e' THEN e{c} WHEN 'f' THEN f{c} ELSE d{c} END"
    if local:
        value = lambda c: f"CASE WHEN i > 0 AND j > 0 AND CASE k WHEN 'e' THEN es WHEN 'f' THEN fs ELSE ds END > 0 THEN CASE k WHEN 'e' THEN e{c} WHEN 'f' THEN f{c} ELSE d{c} END ELSE 0 END"
    carried = "id, a, b, d, i, j, hs, hm, hl, coalesce(es, {0}) AS es, coalesce(em, 0) AS em, coalesce(el, 0) AS el, coalesce(fs, {0}) AS fs, coalesce(fm, 0) AS fm, coalesce(fl, 0) AS fl, ls, lm, ll".format(low)
    step = f"""SELECT {carried} FROM (SELECT *, {value('s')} AS hs, {value('m')} AS hm, {value('l')} AS hl, lhs AS ls, lhm AS lm, lhl AS ll FROM (SELECT *, {kind} AS k FROM (
      SELECT *, {gap('u', 'f')}, {gap('l', 'e')}, uls + score AS ds, ulm + CAST(a[i] = b[j] AS INTEGER) AS dm, ull + 1 AS dl FROM (
        SELECT id, a, b, d + 1 AS d, i + CAST(src = 'u' AS INTEGER) AS i, j + CAST(src = 'l' AS INTEGER) AS j, {got}
        FROM cells CROSS JOIN (VALUES ('u'), ('l')) v(src) WHERE CASE src WHEN 'u' THEN i < length(a) ELSE j < length(b) END GROUP BY ALL) LEFT JOIN scores ON xy = a[i] || b[j])))"""
    end = "SELECT id, first(hm ORDER BY hs DESC, d, i) FILTER (hs > 0) AS matches, coalesce(first(hl ORDER BY hs DESC, d, i) FILTER (hs > 0), 0) AS length, any_value(length(a)) AS la, any_value(length(b)) AS lb FROM cells GROUP BY id" if local else "SELECT id, hm AS matches, hl AS length, length(a) AS la, length(b) AS lb FROM cells WHERE i = length(a) AND j = length(b)"
    start = f"SELECT id, a, b, 0, 0, 0, 0, 0, 0, {low}, 0, 0, {low}, 0, 0, NULL::INTEGER, NULL::INTEGER, NULL::INTEGER FROM pairs"
    return f"WITH RECURSIVE {pairs}, scores(xy, score) AS (VALUES {scores}), cells(id, a, b, d, i, j, hs, hm, hl, es, em, el, fs, fm, fl, ls, lm, ll) AS ({start} UNION ALL {step}), found AS ({end})"


_N = "names AS (SELECT min(p_partkey) AS id, upper(p_name) AS s FROM part GROUP BY p_name), pairs AS (SELECT {id} AS id, q.s AS a, r.s AS b FROM names r CROSS JOIN names q {where})"
_BOTH = "r.id * 1000000 + q.id"
_GLOBAL = "round(1 - matches / greatest(la, lb, length)::DOUBLE, 6)"
_LOCAL = "round(CASE WHEN length = 0 OR least(length / la::DOUBLE, length / lb::DOUBLE) < 0.5 THEN 1 ELSE 1 - matches / length::DOUBLE END, 6)"


def oracle_sql() -> dict[str, str]:
    edges = f"WITH {_E} SELECT src, dst, round(weight, 6) AS weight FROM e"
    sizes = "SELECT cluster, count(*) AS size FROM c GROUP BY cluster"
    jaccard = "1 - c / (a.n + b.n - c)"
    return {
        "tanimoto_real_zip": f"WITH {_P} SELECT src AS id, round({_D}, 6) AS distance FROM p WHERE dst = src + 1",
        "tanimoto_real_edges": edges,
        "tanimoto_real_knn": f"WITH {_P}, d AS (SELECT src, dst, {_D} AS distance FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM d) SELECT src AS query_id, CAST(rank AS INTEGER) AS rank, dst AS ref_id, round(distance, 6) AS distance FROM k WHERE rank <= {KNN}",
        "tanimoto_bit_zip": f"WITH {_T}, i AS (SELECT x.id, count(*)::DOUBLE AS c FROM t x JOIN t y ON y.id = x.id + 1 AND x.w = y.w GROUP BY x.id) SELECT a.id, round(1 - coalesce(c, 0) / (a.n + b.n - coalesce(c, 0)), 6) AS distance FROM n a JOIN n b ON b.id = a.id + 1 LEFT JOIN i ON i.id = a.id",
        "tanimoto_bit_edges": f"WITH {_T}, i AS (SELECT x.id AS src, y.id AS dst, count(*)::DOUBLE AS c FROM t x JOIN t y ON x.w = y.w AND x.id < y.id GROUP BY x.id, y.id) SELECT src, dst, round({jaccard}, 6) AS weight FROM i JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE {jaccard} < {ALIKE}",
        "tanimoto_bit_knn": f"WITH {_T}, q AS (SELECT item_id AS id, unnest(list_distinct(string_split(text, ' '))) AS w FROM benchmark), m AS (SELECT id, count(*) AS n FROM q GROUP BY id), i AS (SELECT q.id AS qid, t.id AS rid, count(*)::DOUBLE AS c FROM q JOIN t USING (w) GROUP BY q.id, t.id), d AS (SELECT a.id AS query_id, b.id AS ref_id, 1 - coalesce(c, 0) / (a.n + b.n - coalesce(c, 0)) AS distance FROM m a CROSS JOIN n b LEFT JOIN i ON qid = a.id AND rid = b.id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM d) SELECT query_id, CAST(rank AS INTEGER) AS rank, ref_id, round(distance, 6) AS distance FROM k WHERE rank <= {KNN}",
        "bit_fingerprint": "SELECT doc_id, CAST(len(list_distinct(list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w) % 256))) AS BIGINT) AS n_on FROM documents",
        "graph_summary": f"WITH {_E} SELECT (SELECT count(*) FROM embeddings) AS n, count(*) AS edges, round(sum(weight), 4) AS m, round(sum(1 - weight), 4) AS total_weight FROM e",
        "weight_mapping": f"WITH {_E} SELECT src, dst, round(weight, 6) AS similarity, round(1 / (1 + weight), 6) AS distance, round(1 - weight, 6) AS similarity_complement, 1.0::DOUBLE AS unweighted FROM e",
        "neighbors": f"WITH {_E} SELECT src AS v, dst AS u, round(1 / (1 + weight), 6) AS w FROM e UNION ALL SELECT dst, src, round(1 / (1 + weight), 6) FROM e",
        "strength": f"WITH {_E}, s AS (SELECT src AS v, 1 / (1 + weight) AS w FROM e UNION ALL SELECT dst, 1 / (1 + weight) FROM e) SELECT id, round(coalesce(sum(w), 0), 6) AS strength FROM v LEFT JOIN s ON s.v = v.id GROUP BY id",
        "supply_strength": "WITH s AS (SELECT l_partkey AS id, l_quantity AS w FROM lineitem UNION ALL SELECT -l_suppkey - 1, l_quantity FROM lineitem), n AS (SELECT p_partkey AS id FROM part UNION ALL SELECT -s_suppkey - 1 FROM supplier) SELECT n.id, round(coalesce(sum(w), 0), 6) AS strength FROM n LEFT JOIN s ON s.id = n.id GROUP BY n.id",
        "subgraph": f"WITH {_E}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM v WHERE label <= 2) SELECT a.new_id AS src, b.new_id AS dst, round(1 - weight, 6) AS weight FROM e JOIN k a ON a.id = src JOIN k b ON b.id = dst",
        "components": f"{_C} SELECT id, cluster FROM c",
        "component_sizes": f"{_C} {sizes}",
        "order_components": "WITH k AS (SELECT o_custkey, count(*) + 1 AS size FROM orders GROUP BY o_custkey) SELECT size, count(*) AS components FROM k GROUP BY size",
        "largest_cluster": f"{_C} {sizes} ORDER BY size DESC, cluster LIMIT 1",
        "partition": _split_sql("SELECT id, cluster FROM c", False),
        "partition_filtered": _split_sql("SELECT id, CAST(label AS BIGINT) AS cluster FROM v", True),
        "communities_invariants": f"{_C}, k AS (SELECT v, sum(w) AS k FROM (SELECT src AS v, 1 - weight AS w FROM e UNION ALL SELECT dst, 1 - weight FROM e) GROUP BY v), t AS (SELECT sum(k) AS t, sum(k * k) AS kk FROM k), q AS (SELECT sum(s * s) AS q FROM (SELECT sum(k) AS s FROM k JOIN c ON c.id = k.v GROUP BY cluster)) SELECT 0::BIGINT AS crossing, (SELECT count(*) FROM embeddings) AS vertices, round(1 - q / (t * t), 6) AS components_modularity, round(-kk / (t * t), 6) AS singletons_modularity, true AS no_less FROM t, q",
        "ann_quality": f"WITH {_E} SELECT count(*) AS exact_edges, (SELECT count(*) * {KNN} FROM embeddings) AS exact_neighbors, 0::BIGINT AS wrong, true AS edge_recall, true AS neighbor_recall FROM e",
        "index_fields": f"WITH n AS (SELECT count(*) AS n FROM embeddings), m AS (SELECT n, CAST(ceil(ln(n) * {HNSWConfig().m_l}) AS BIGINT) + 2 AS l FROM n) SELECT n AS dataset_size, l AS max_layers, l AS layers, n AS in_lowest, 0::BIGINT AS own, true AS is_built, 1::BIGINT AS entries FROM m",
        "index_save_load": "SELECT count(*) AS dataset_size, true AS same_edges, true AS same_neighbors, 60::BIGINT AS found FROM embeddings",
        "incremental_edges": f"WITH {_E} SELECT src, dst, round(weight, 6) AS weight FROM e WHERE src % 2 = 1 OR dst % 2 = 1",
        "global_align_edges": _align_sql(_N.format(id=_BOTH, where="WHERE r.id < q.id"), False) + f" SELECT id // 1000000 AS src, id % 1000000 AS dst, {_GLOBAL} AS weight FROM found WHERE {_GLOBAL} < 0.6",
        "global_align_knn": _align_sql(_N.format(id=_BOTH, where=""), False) + f", k AS (SELECT id % 1000000 AS query_id, id // 1000000 AS ref_id, {_GLOBAL} AS distance FROM found), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM k) SELECT query_id, CAST(rank AS INTEGER) AS rank, ref_id, distance FROM o WHERE rank <= 3",
        "global_align_zip": _align_sql("pairs AS (SELECT p_partkey AS id, upper(p_type) AS a, upper(p_name) AS b FROM part)", False) + f" SELECT id, {_GLOBAL} AS distance FROM found",
        "local_align_edges": _align_sql(_N.format(id=_BOTH, where="WHERE r.id < q.id"), True) + f" SELECT id // 1000000 AS src, id % 1000000 AS dst, {_LOCAL} AS weight FROM found WHERE {_LOCAL} < 0.6",
        "global_align_pruned": "WITH n AS (SELECT count(DISTINCT p_name) AS n FROM part) SELECT n AS names, CAST(n * (n - 1) / 2 AS BIGINT) AS pairs, 0::BIGINT AS lost, 0::BIGINT AS added FROM n",
        "global_align_fixture": "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 0.15::DOUBLE), (0, 2, 0.05), (0, 3, 0.35), (0, 4, 0.6522), (1, 2, 0.15), (1, 3, 0.5), (1, 4, 0.7), (2, 3, 0.4), (2, 4, 0.6522), (3, 4, 0.7826)) t(src, dst, weight)",
        "global_align_threshold": "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT), (0, 2), (0, 3), (1, 2), (2, 3)) t(src, dst)",
        "global_align_fixture_knn": "SELECT * FROM (VALUES (3::BIGINT, 1::INTEGER, 0::BIGINT, 0.35::DOUBLE), (3, 2, 2, 0.4), (4, 1, 0, 0.6522), (4, 2, 2, 0.6522)) t(query_id, rank, ref_id, distance)",
        "global_align_fixture_zip": "SELECT * FROM (VALUES (0::BIGINT, 0.6667::DOUBLE), (1, 0.3333), (2, 0.0)) t(id, distance)",
        # 8 matches of an alignment of 10; 3 of one of 4
        "global_identity_modes": "SELECT * FROM (VALUES ('AlignmentLength', 0::BIGINT, 0.2::DOUBLE), ('AlignmentLength', 1, 0), ('AlignmentLength', 2, 0.25), ('MaxSeqLength', 0, 0.2), ('MaxSeqLength', 1, 0), ('MaxSeqLength', 2, 0.25), ('MinSeqLength', 0, 0), ('MinSeqLength', 1, 0), ('MinSeqLength', 2, 0), ('MaxLength', 0, 0.2), ('MaxLength', 1, 0), ('MaxLength', 2, 0.25)) t(mode, id, distance)",
        # all 8 residues of one are 8 of the other's 14: the long first sequence is the reference (target), then the query
        "local_coverage_modes": "SELECT * FROM (VALUES ('BothQueryTarget', 0::BIGINT, 1.0::DOUBLE), ('BothQueryTarget', 1, 0), ('BothQueryTarget', 2, 1), ('Target', 0, 1), ('Target', 1, 0), ('Target', 2, 0), ('Query', 0, 0), ('Query', 1, 0), ('Query', 2, 1), ('LengthRatio', 0, 1), ('LengthRatio', 1, 0), ('LengthRatio', 2, 1), ('ShorterSeq', 0, 0), ('ShorterSeq', 1, 0), ('ShorterSeq', 2, 0)) t(mode, id, distance)",
        "structure_distance": "SELECT * FROM (VALUES (0::BIGINT, 0.0::DOUBLE), (1, 0.0)) t(id, distance)",
        "fingerprint_objects": "SELECT 5::BIGINT AS length, 3::BIGINT AS on_bits, 5.0::DOUBLE AS norm_sq, true AS round_trip, 0.5::DOUBLE AS bit_distance, 0.6667::DOUBLE AS real_distance",
        "degree": f"WITH {_E}, s AS (SELECT src AS v FROM e UNION ALL SELECT dst FROM e) SELECT id, count(s.v) AS degree FROM v LEFT JOIN s ON s.v = v.id GROUP BY id",
        "subgraph_mapping": "SELECT vec_id AS old_id, row_number() OVER (ORDER BY vec_id) - 1 AS new_id FROM embeddings WHERE label <= 2",
        "fasta_read": "SELECT * FROM (VALUES (0::BIGINT, 'seq1 first protein', 'ACDEFGHI'), (1, 'seq2', 'PQRSTVWY'), (2, 'empty', '')) t(id, header, sequence)",
        "smi_read": "SELECT * FROM (VALUES (0::BIGINT, 'benzene', 'c1ccccc1'), (1, '3', 'CC(=O)O'), (2, 'ethyl alcohol', 'CCO')) t(id, label, smiles)",
        "csv_mol_read": "SELECT * FROM (VALUES (0::BIGINT, 'benzene', 'c1ccccc1'), (1, 'water', 'O')) t(id, label, smiles)",
        "edgelist_round_trip": edges,
        "edge_table_round_trip": edges,
        "edge_records_round_trip": f"WITH {_E} SELECT src, dst, round(CAST(CAST(weight AS FLOAT) AS DOUBLE), 4) AS weight, (SELECT count(*) FROM embeddings) AS nodes FROM e",
        "sdf_read": "SELECT * FROM (VALUES (0::BIGINT, '0', 'one' || chr(10) || 'M  END' || chr(10)), (1, '1', 'two' || chr(10) || chr(10) || 'M  END' || chr(10))) t(id, label, molblock)",
        "molecule_file_read": "SELECT * FROM (VALUES (0::BIGINT, 'benzene', 'c1ccccc1', 4::BIGINT), (1, '1', 'CCO', 1), (2, '2', 'CC', 1)) t(id, label, smiles, on_bits)",
        "pdb_read": "SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE), (0, 4.5, -5.0, 6.25)) t(id, x, y, z)",
    }
