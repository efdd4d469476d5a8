"""Approximate neighbours: navigable small-world graphs, one per shard.

Items are dealt into shards of bounded size by hash. A task builds the layered graph of its shard (levels from a hash
of the id, greedy descent, best-first search, neighbour selection by distance diversity) and records every evaluated
pair under the threshold. For pairs across shards each shard's graph is searched for the items of the others. So edges
have exact distances (precision 1), and recall is what the search finds. Indexes are tables.
"""

from __future__ import annotations

import heapq
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from kinsplit.config import HNSWConfig
from kinsplit.functions.kernels import Kernel, _ranges, make_kernel
from kinsplit.operators.edges import EdgeStore
from kinsplit.operators.proximity import _items
from kinsplit.plans.storage import materialize

SHARD_ROWS = 5_000
SLICE_ROWS = 20_000  # queries a task
WALKS = 2_000_000  # queries by items of a graph, whose walks go on side by side
MOST_TASKS = 2_000
AT_ONCE = 256  # vectors whose distances among one another are one product
BEAM = 4  # items that a walk looks from in a round
FORMAT_VERSION = 1
NODES = "shard int, layer int, node long, neighbors array<long>, entry boolean"
_MIX = 0x9E3779B97F4A7C15


def max_layers(n: int, m_l: float) -> int:
    return math.ceil(math.log(n) * m_l) + 2 if n > 0 else 0


def _tasks(groups: int) -> int:
    """Tasks for groups whose work is far more than their bytes tell, so that few meet in one."""
    return max(1, min(4 * groups, MOST_TASKS))


class Graph:
    """The graph of one shard, by position in ``ids``; ``total``: items of all shards, which fix the number of layers."""

    def __init__(self, ids: list[int], items: list, kernel: Kernel, config: HNSWConfig, total: int | None = None):
        self.ids, self.kernel, self.c = ids, kernel, config
        self.loaded = kernel.load(items)
        self.layers: list[dict[int, list[int]]] = [{} for _ in range(max_layers(total or len(ids), config.m_l))]
        self.entry: tuple[int, int] | None = None
        self.near: dict[tuple[int, int], float] = {}

    def _take(self, rows: list[int]):
        return self.loaded[rows] if isinstance(self.loaded, np.ndarray) else [self.loaded[i] for i in rows]

    def distances(self, query, rows: list[int], own: int | None = None) -> list[float]:
        """From a loaded query of one item to rows; pairs under the threshold are kept when the query is of the shard."""
        d = self.kernel.block(self._take(rows), query)[:, 0]
        if own is not None and self.c.keep_all_edges:
            for at in np.flatnonzero(d < self.c.proximity_threshold).tolist():
                if rows[at] != own:
                    self.near[min(rows[at], own), max(rows[at], own)] = float(d[at])
        return d.tolist()

    def _among(self, rows: list[int]) -> np.ndarray:
        """Distances of vectors among one another, by one product; pairs under the threshold are kept."""
        x = self._take(rows)
        d = self.kernel.block(x, x)
        if self.c.keep_all_edges:
            for a, b in zip(*(at.tolist() for at in np.nonzero(d < self.c.proximity_threshold))):
                if rows[a] < rows[b]:
                    self.near[rows[a], rows[b]] = float(d[a, b])
        return d

    def level(self, i: int) -> int:
        h = (self.ids[i] * _MIX + 0x1234567) & ((1 << 64) - 1)
        h ^= h >> 31
        h = (h * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
        u = ((h >> 11) + 1) / (1 << 53)
        return min(int(-math.log(u) * self.c.m_l), len(self.layers) - 1)

    def search_layer(self, query, start: list[tuple[float, int]], ef: int, layer: int, strict: bool, own: int | None = None) -> list[tuple[float, int]]:
        """Best-first; not strict, the results may outgrow ef while the worst of them is under the threshold."""
        near = self.layers[layer]
        seen = {i for _, i in start}
        todo, best = list(start), [(-d, -i) for d, i in start]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            full = len(best) >= ef and (strict or -best[0][0] >= self.c.proximity_threshold)
            if full and d > -best[0][0]:
                break
            fresh = [j for j in near.get(i, ()) if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for j, x in zip(fresh, self.distances(query, fresh, own)):
                room = len(best) < ef or (not strict and -best[0][0] < self.c.proximity_threshold)
                if room or x < -best[0][0]:
                    heapq.heappush(todo, (x, j))
                    heapq.heappush(best, (-x, -j))
                    while len(best) > ef and (strict or -best[0][0] >= self.c.proximity_threshold):
                        heapq.heappop(best)
        return sorted((-d, -i) for d, i in best)

    def select(self, found: list[tuple[float, int]], m: int, layer: int, own: int | None) -> list[int]:
        found = sorted({i: d for d, i in found if i != own}.items(), key=lambda x: (x[1], x[0]))
        if self.c.extend_candidates and found:
            known = {i for i, _ in found} | {own}
            more = sorted({j for i, _ in found for j in self.layers[layer].get(i, ())} - known)
            if more:
                found = sorted([*found, *zip(more, self.distances(self._take([own]), more, own))], key=lambda x: (x[1], x[0]))
        if not self.c.use_heuristic:
            kept, spare = [i for i, _ in found[:m]], []
        else:
            kept, spare, rows = [], [], [i for i, _ in found]
            least = np.full(len(rows), math.inf)  # from each to the nearest that is kept
            among = self._among(rows) if isinstance(self.loaded, np.ndarray) and len(rows) <= AT_ONCE else None
            for at, (i, d) in enumerate(found):
                if len(kept) >= m:
                    break
                if least[at] > d:
                    kept.append(i)
                    if among is not None:
                        least = np.minimum(least, among[at])
                    elif len(kept) < m and at + 1 < len(rows):
                        least[at + 1 :] = np.minimum(least[at + 1 :], self.distances(self._take([i]), rows[at + 1 :], i))
                else:
                    spare.append(i)
            if self.c.keep_pruned_connections:
                kept += spare[: m - len(kept)]
        if layer == 0 and self.c.threshold_based_neighbourhood:
            has = set(kept)
            kept += [i for i, d in found if d < self.c.proximity_threshold and i not in has]
        return kept

    def insert(self, i: int) -> None:
        level, query = self.level(i), self._take([i])
        if self.entry is None:
            for layer in range(level + 1):
                self.layers[layer][i] = []
            self.entry = (i, level)
            return
        at, top = self.entry
        ep = [(self.distances(query, [at], i)[0], at)]
        for layer in range(top, level, -1):
            ep = self.search_layer(query, ep, self.c.ef_init, layer, True, i)[:1]
        for layer in range(min(level, top), -1, -1):
            ep = self.search_layer(query, ep, self.c.ef_construction, layer, self.c.strict_ef, i)
            chosen = self.select(ep, self.c.m, layer, i)
            self.layers[layer][i] = chosen
            most = self.c.m_max0 if layer == 0 else self.c.m_max
            for j in chosen:
                links = self.layers[layer].setdefault(j, [])
                links.append(i)
                if len(links) > most:
                    self.layers[layer][j] = self.select(list(zip(self.distances(self._take([j]), links, j), links)), most, layer, j)
        if level > top:
            for layer in range(top + 1, level + 1):
                self.layers[layer][i] = []
            self.entry = (i, level)

    def build(self) -> Graph:
        order = np.random.default_rng(0).permutation(len(self.ids)).tolist() if self.c.shuffle else range(len(self.ids))
        for i in order:
            self.insert(i)
        return self

    def _links(self, layer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each item's neighbours begin, how many they are, and all of them."""
        n, near = np.zeros(len(self.ids), np.int64), self.layers[layer]
        for i, links in near.items():
            n[i] = len(links)
        flat = np.fromiter((j for i in sorted(near) for j in near[i]), np.int64, int(n.sum()))
        return np.cumsum(n) - n, n, flat

    def _walk(self, queries, start: np.ndarray, ef: int, layer: int, strict: bool, found: list | None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, items) that the best-first walks of all queries from an item each end with, nearest first, infinite where there are no more.

        The walks go on side by side: in a round, each one looks at the neighbours of the BEAM nearest items that it has
        not looked from, as long as these are no farther than its ef-th nearest or, if not strict, under the threshold.
        What is under the threshold is put into ``found``.
        """
        first, n, flat = self._links(layer)
        size, near, all_ = len(self.ids), self.c.proximity_threshold, np.arange(len(start))
        seen = np.zeros(len(start) * size, bool)
        seen[all_ * size + start] = True
        dist, item, fresh = np.full((len(start), ef), math.inf), np.zeros((len(start), ef), np.int64), np.zeros((len(start), ef), bool)
        dist[:, 0], item[:, 0], fresh[:, 0] = self.kernel.pairs(self.loaded, queries, start, all_), start, True
        if found is not None:
            found.append((all_[dist[:, 0] < near], start[dist[:, 0] < near], dist[dist[:, 0] < near, 0]))
        while True:
            far = dist[:, ef - 1] if strict else np.maximum(dist[:, ef - 1], near)
            todo = fresh & (dist <= far[:, None])
            q, at = np.nonzero(todo & (np.cumsum(todo, axis=1) <= BEAM))
            if not len(q):
                return dist, item
            fresh[q, at] = False
            of = item[q, at]
            pairs = np.repeat(q * size, n[of]) + flat[_ranges(first[of], n[of])]
            pairs = np.sort(pairs[~seen[pairs]])
            pairs = pairs[np.diff(pairs, prepend=-1) > 0]
            seen[pairs] = True
            q, i = np.divmod(pairs, size)
            d = self.kernel.pairs(self.loaded, queries, i, q)
            if found is not None:
                found.append((q[d < near], i[d < near], d[d < near]))
            kept = d <= far[q]
            q, i, d = q[kept], i[kept], d[kept]
            rows, place, more = np.unique(q, return_inverse=True, return_counts=True)
            if not len(rows):
                continue
            col = np.arange(len(q)) - np.repeat(np.cumsum(more) - more, more) + dist.shape[1]
            new = [np.concatenate([x[rows], np.full((len(rows), more.max()), none)], axis=1) for x, none in ((dist, math.inf), (item, 0), (fresh, False))]
            for x, value in zip(new, (d, i, True)):
                x[place, col] = value
            order = np.argsort(new[0], axis=1, kind="stable")
            width = ef if strict else max(ef, int((new[0] < near).sum(axis=1).max()))
            if width > dist.shape[1]:
                dist, item, fresh = (np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=none) for x, none in ((dist, math.inf), (item, 0), (fresh, False)))
            order = order[:, : dist.shape[1]]
            for x, y in zip((dist, item, fresh), new):
                x[rows, : order.shape[1]] = np.take_along_axis(y, order, 1)

    def walks(self, queries, k: int | None, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, distance) of loaded queries of other items: the k nearest of each that are found; without k, all that is evaluated under the threshold."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, WALKS // max(1, len(self.ids)))
        for s in range(0, len(queries) if self.entry else 0, step):
            some, found = queries[s : s + step], [] if k is None else None
            at = np.full(len(some), self.entry[0], np.int64)
            for layer in range(self.entry[1], 0, -1):
                at = self._walk(some, at, ef, layer, False, found)[1][:, 0]
            dist, item = self._walk(some, at, max(ef, k or 0), 0, self.c.strict_ef, found)
            if k is None:
                q, i, d = (np.concatenate(c) for c in zip(*found))
                _, once = np.unique(q * len(self.ids) + i, return_index=True)  # layers share items
                out.append((q[once] + s, i[once], d[once]))
            else:
                order = np.lexsort((item, dist), axis=1)[:, :k]
                dist, item = np.take_along_axis(dist, order, 1), np.take_along_axis(item, order, 1)
                q, col = np.nonzero(np.isfinite(dist))
                out.append((q + s, item[q, col], dist[q, col]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def rows(self, shard: int):
        for layer, near in enumerate(self.layers):
            for i in sorted(near):
                yield shard, layer, self.ids[i], [self.ids[j] for j in near[i]], bool(self.entry and self.entry == (i, layer))

    @staticmethod
    def of_rows(nodes: pd.DataFrame, ids: list[int], items: list, kernel: Kernel, config: HNSWConfig, total: int | None = None) -> Graph:
        g = Graph(ids, items, kernel, config, total)
        at = {v: i for i, v in enumerate(ids)}
        for layer, node, near, entry in zip(nodes["layer"], nodes["node"], nodes["neighbors"], nodes["entry"]):
            g.layers[layer][at[node]] = [at[j] for j in near]
            if entry:
                g.entry = (at[node], layer)
        return g


class HNSWIndex:
    """A built index: ``nodes`` (shard, layer, node, neighbors, entry), ``proximity_edges``, and what made it."""

    def __init__(self, nodes: DataFrame, proximity_edges: DataFrame | None, config: HNSWConfig, dataset_size: int, shards: int):
        self.nodes, self.proximity_edges, self.config, self.dataset_size, self.shards = nodes, proximity_edges, config, dataset_size, shards

    @property
    def max_layers(self) -> int:
        return max_layers(self.dataset_size, self.config.m_l)

    @property
    def layers(self) -> list[DataFrame]:
        return [self.nodes.where(F.col("layer") == i).select("node", "neighbors") for i in range(self.max_layers)]

    @property
    def shard_entries(self) -> DataFrame:
        """(shard, node, layer): where each shard's graph is entered; shards have no links to one another."""
        return self.nodes.where("entry").select("shard", "node", "layer")

    @property
    def entry_point(self) -> list[tuple[int, int]]:
        """(node, layer) of the index, the highest of the shards' entries, ties by the lower shard; empty without items."""
        return [(r["node"], r["layer"]) for r in self.shard_entries.orderBy(F.desc("layer"), "shard").limit(1).collect()]

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        spark = self.nodes.sparkSession
        meta = {"format_version": FORMAT_VERSION, "dataset_size": self.dataset_size, "shards": self.shards, "config": self.config.dict(), "edges": self.proximity_edges is not None}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        if self.proximity_edges is not None:
            self.proximity_edges.write.mode("overwrite").parquet(f"{path}/edges")

    @staticmethod
    def load(path: str, spark: SparkSession | None = None) -> HNSWIndex:
        spark = spark or SparkSession.active()
        try:
            meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        except Exception as e:
            raise RuntimeError(f"cannot read the index {path}: {str(e).splitlines()[0]}") from e
        if meta["format_version"] != FORMAT_VERSION:
            raise RuntimeError(f"{path} has format {meta['format_version']}; this version reads {FORMAT_VERSION}")
        edges = spark.read.parquet(f"{path}/edges") if meta["edges"] else None
        return HNSWIndex(spark.read.parquet(f"{path}/nodes"), edges, HNSWConfig(**meta["config"]), meta["dataset_size"], meta["shards"])

    def __str__(self) -> str:
        n = {r["layer"]: r["n"] for r in self.nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}
        edges = self.proximity_edges.count() if self.proximity_edges is not None else 0
        return f"HNSWIndex(dataset_size={self.dataset_size}, has_been_built=True, entry_point={self.entry_point}, max_layers={self.max_layers}, n_edges={edges}, layers={[n[k] for k in sorted(n)]}, config={self.config})"

    __repr__ = __str__


class HNSWState:
    """Builds and searches an index over (id, item) rows with unique ids."""

    def __init__(self, variant, data: DataFrame, *args, config: HNSWConfig | None = None, id_col: str = "id", item_col: str = "item", shard_rows: int = SHARD_ROWS, **kwargs):
        self.kernel, self.config = make_kernel(variant, *args, **kwargs), config or HNSWConfig()
        self.items = _items(data, id_col, item_col)
        self.size = self.items.count()
        self.shards = max(1, -(-self.size // shard_rows))
        self.dealt = self.items.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(self.shards)).cast("int"))
        self._index: HNSWIndex | None = None

    @property
    def is_built(self) -> bool:
        return self._index is not None

    @property
    def index(self) -> HNSWIndex:
        if self._index is None:
            raise RuntimeError("the index has not been built")
        return self._index

    def build(self, progress: bool = True) -> HNSWState:
        """Build once; a second call is a RuntimeError. No rows make an empty index."""
        if self._index is not None:
            raise RuntimeError("the index has already been built")
        kernel, config, total = self.kernel, self.config, self.size

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            shard = int(pdf["shard"].iloc[0])
            g = Graph(pdf["id"].tolist(), pdf["item"].tolist(), kernel, config, total).build()
            out = [(s, layer, node, near, e, None) for s, layer, node, near, e in g.rows(shard)]
            out += [(shard, -1, g.ids[a], [g.ids[b]], False, d) for (a, b), d in g.near.items()]
            return pd.DataFrame(out, columns=["shard", "layer", "node", "neighbors", "entry", "weight"])

        built = materialize(self.dealt.repartition(_tasks(self.shards), "shard").groupBy("shard").applyInPandas(run, NODES + ", weight double"), "index")
        nodes = built.where("layer >= 0").drop("weight")
        edges = None
        if config.keep_all_edges:
            own = built.where("layer = -1").select(F.col("node").alias("a"), F.col("neighbors")[0].alias("b"), "weight")
            if self.shards > 1:
                own = own.unionByName(self._across(nodes))
            edges = materialize(own.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("weight").alias("weight")), "edges")
        self._index = HNSWIndex(nodes, edges, config, self.size, self.shards)
        return self

    def _across(self, nodes: DataFrame) -> DataFrame:
        """(a, b, weight): what the graphs of other shards find under the threshold."""
        q = self.dealt.select("id", "item", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))).alias("to"), "shard").where("to < shard").select("id", "item", F.col("to").alias("shard"))
        found = self._search(q, nodes, None, self.config.ef_construction)
        return found.select(F.col("query_id").alias("a"), F.col("ref_id").alias("b"), F.col("distance").alias("weight"))

    def _search(self, queries: DataFrame, nodes: DataFrame, k: int | None, ef: int) -> DataFrame:
        """Each query (id, item, shard) in its shard's graph; without k, all that is evaluated under the threshold.

        A shard's queries are dealt into slices of bounded size; the shard's graph is sent once a slice.
        """
        kernel, config, total = self.kernel, self.config, self.size
        counts = [(x["shard"], -(-x["n"] // SLICE_ROWS)) for x in queries.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
        slices = lambda name: F.broadcast(queries.sparkSession.createDataFrame(counts or [(0, 1)], f"shard int, {name} long"))
        dealt = queries.join(slices("parts"), "shard").select("id", "item", "shard", F.pmod(F.xxhash64("id"), F.col("parts")).alias("slice"))
        base = self.dealt.select("shard", F.col("id").alias("node"), F.col("item").alias("item"), F.lit(-1).alias("layer"), F.lit(None).cast("array<long>").alias("neighbors"), F.lit(False).alias("entry"))
        graph = base.unionByName(nodes.select("shard", "node", F.lit(None).cast(base.schema["item"].dataType).alias("item"), "layer", "neighbors", "entry"))

        graph = graph.join(slices("copies"), "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")

        def run(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
            query, ref, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if len(q) and len(g):
                items = g[g["layer"] < 0].sort_values("node")
                graph = Graph.of_rows(g[g["layer"] >= 0], items["node"].tolist(), items["item"].tolist(), kernel, config, total)
                query, ref, distance = graph.walks(kernel.load(q["item"].tolist()), k, ef)
                query, ref = q["id"].to_numpy(np.int64)[query], np.array(graph.ids, np.int64)[ref]
            return pd.DataFrame({"query_id": query, "ref_id": ref, "distance": distance})

        tasks = _tasks(sum(n for _, n in counts))
        dealt, graph = dealt.repartition(tasks, "shard", "slice"), graph.repartition(tasks, "shard", "part")
        return dealt.groupBy("shard", "slice").cogroup(graph.groupBy("shard", "part")).applyInPandas(run, "query_id long, ref_id long, distance double")

    def search(self, queries: DataFrame, k: int = 1, ef: int = 64, threads: int = 0, progress: bool = True, id_col: str = "id", item_col: str = "item") -> DataFrame:
        """(query_id, rank, ref_id, distance), nearest first, at most k a query; RuntimeError before build."""
        index = self.index
        q = _items(queries, id_col, item_col).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))))
        found = self._search(q, index.nodes, k, ef)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "ref_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "distance")

    def edges(self) -> EdgeStore | None:
        """Every evaluated pair under the threshold; None where ``keep_all_edges`` is off."""
        e = self.index.proximity_edges
        return None if e is None else EdgeStore(self.items.select("id"), e)

    def get_layer(self, i: int) -> DataFrame:
        """(id, neighbors) of every item, empty lists for those that the layer does not have; IndexError out of range."""
        if not 0 <= i < self.index.max_layers:
            raise IndexError(f"layer {i} of {self.index.max_layers}")
        on = self.items.select("id").join(self.index.nodes.where(F.col("layer") == i).select(F.col("node").alias("id"), "neighbors"), "id", "left")
        return on.select("id", F.coalesce("neighbors", F.array().cast("array<long>")).alias("neighbors"))

    def save(self, path: str) -> None:
        """Tables below ``path``; neither data nor kernel is stored."""
        self.index.save(path)

    @staticmethod
    def load(variant, path: str, data: DataFrame, *args, config: HNSWConfig | None = None, **kwargs) -> HNSWState:
        """RuntimeError where the format, the number of rows, or a given config is not the saved one."""
        index = HNSWIndex.load(path, data.sparkSession)
        state = HNSWState(variant, data, *args, config=index.config, **kwargs)
        if state.size != index.dataset_size:
            raise RuntimeError(f"the index is of {index.dataset_size} rows, the data has {state.size}")
        if config is not None and config != index.config:
            raise RuntimeError("the index was built with another config")
        state.shards = index.shards
        state.dealt = state.items.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(index.shards)).cast("int"))
        state._index = index
        return state
