"""Leiden communities, each connected component by itself.

A vertex only ever moves to a neighbour's community, so communities never span components and the components can be
worked on in parallel; the one global number, the sum of all strengths, is passed in. Within a component this is the
published algorithm: queue-based local moving, refinement into well-connected parts, aggregation with summed weights.
Randomness is seeded by the component's smallest vertex, so reruns agree.

A component of more than TASK_EDGES edges does not go to one task as it is. Its vertices first move in rounds over
tables: in each, half of them (by hash) go to the neighbouring community of most gain. Communities are split into their
connected parts, and these become the vertices of a smaller graph, again and again until the component fits.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinsplit.config import LeidenObjective
from kinsplit.operators.clusters import relabel
from kinsplit.operators.components import star_forest
from kinsplit.operators.graph import CsrGraph
from kinsplit.plans.storage import materialize, release

TASK_EDGES = 5_000_000
ROUNDS = 10  # of moves on one level
SHRINK = 0.95  # a level that leaves more than this share of the vertices is the last


class _Level:
    """A weighted graph without self-loops: adjacency dicts and vertex masses."""

    def __init__(self, near: list[dict[int, float]], mass: list[float]):
        self.near, self.mass = near, mass


def _move(g: _Level, part: list[int], gamma: float, rng: np.random.Generator) -> bool:
    """Local moving until no vertex gains; True if any moved. Staying is scored like moving."""
    total: dict[int, float] = {}
    for v, c in enumerate(part):
        total[c] = total.get(c, 0.0) + g.mass[v]
    free = max(part, default=-1) + 1
    queue = deque(rng.permutation(len(part)).tolist())
    waits, moved = [True] * len(part), False
    while queue:
        v = queue.popleft()
        waits[v] = False
        c, k = part[v], g.mass[v]
        total[c] -= k
        to: dict[int, float] = {c: 0.0}
        for u, w in g.near[v].items():
            to[part[u]] = to.get(part[u], 0.0) + w
        best, gain = c, to[c] - gamma * k * total[c]
        for d, w in to.items():
            x = w - gamma * k * total[d]
            if x > gain + 1e-12:
                best, gain = d, x
        if gain < -1e-12:
            best, free = free, free + 1
        total[best] = total.get(best, 0.0) + k
        if best != c:
            part[v], moved = best, True
            for u in g.near[v]:
                if part[u] != best and not waits[u]:
                    waits[u] = True
                    queue.append(u)
    return moved


def _refine(g: _Level, part: list[int], gamma: float, beta: float, rng: np.random.Generator) -> list[int]:
    """Within each community, single vertices that are well connected join well-connected parts, drawn by exp(gain / beta)."""
    fine = list(range(len(part)))
    inside: dict[int, float] = {}
    for v, c in enumerate(part):
        inside[c] = inside.get(c, 0.0) + g.mass[v]
    outward = [sum(w for u, w in g.near[v].items() if part[u] == part[v]) for v in range(len(part))]
    mass, out, alone = list(g.mass), list(outward), [True] * len(part)
    for v in rng.permutation(len(part)).tolist():
        whole, k = inside[part[v]], g.mass[v]
        if not alone[v] or outward[v] < gamma * k * (whole - k):
            continue
        to: dict[int, float] = {}
        for u, w in g.near[v].items():
            if part[u] == part[v]:
                to[fine[u]] = to.get(fine[u], 0.0) + w
        options = [(v, 0.0)]
        for s, w in to.items():
            gain = w - gamma * k * mass[s]
            if s != v and gain >= 0 and out[s] >= gamma * mass[s] * (whole - mass[s]):
                options.append((s, gain))
        top = max(x for _, x in options)
        p = np.array([math.exp((x - top) / beta) for _, x in options])
        s = options[int(rng.choice(len(options), p=p / p.sum()))][0]
        if s != v:
            linked = to[s]
            fine[v], alone[v], alone[s] = s, False, False
            mass[s] += k
            out[s] += outward[v] - 2 * linked
            mass[v] = out[v] = 0.0
    return fine


def _dense(labels: list[int]) -> list[int]:
    seen: dict[int, int] = {}
    return [seen.setdefault(c, len(seen)) for c in labels]


def _one_pass(g: _Level, start: list[int], gamma: float, beta: float, rng) -> list[int]:
    where, part = list(range(len(start))), list(start)
    while True:
        _move(g, part, gamma, rng)
        part = _dense(part)
        flat = [part[v] for v in where]
        if max(part, default=-1) + 1 == len(part):
            return flat
        fine = _dense(_refine(g, part, gamma, beta, rng))
        n = max(fine) + 1
        if n == len(fine):  # nothing was merged: go on with the communities themselves
            fine = part
            n = max(fine) + 1
        near: list[dict[int, float]] = [{} for _ in range(n)]
        mass, coarse = [0.0] * n, [0] * n
        for v, c in enumerate(fine):
            mass[c] += g.mass[v]
            coarse[c] = part[v]
            for u, w in g.near[v].items():
                if fine[u] != c:
                    near[c][fine[u]] = near[c].get(fine[u], 0.0) + w
        where = [fine[v] for v in where]
        if n == len(g.near):
            return flat
        g, part = _Level(near, mass), coarse


def leiden(n: int, src, dst, weight, mass, gamma: float, beta: float, n_iterations: int, seed: int) -> list[int]:
    """Community of each vertex 0..n-1; at most n_iterations passes, 0: until one changes nothing."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in zip(src, dst, weight):
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    g, rng, part, k = _Level(near, list(mass)), np.random.default_rng(seed), list(range(n)), 0
    while True:
        k += 1
        nxt = _dense(_one_pass(g, part, gamma, beta, rng))
        if nxt == _dense(part) or k == n_iterations:
            return nxt
        part = nxt


def find_communities(graph: CsrGraph, gamma: float = 1.0, beta: float = 0.01, n_iterations: int = 2, objective: LeidenObjective = LeidenObjective.Modularity, seed: int = 0) -> DataFrame:
    """(id, cluster): Leiden communities, numbered by their smallest ids."""
    edges = graph.weighted
    resolution = gamma
    strengths = graph.strengths()
    if objective is LeidenObjective.Modularity:
        total = strengths.agg(F.sum("strength")).first()[0] or 0.0
        resolution = gamma / total if total else 0.0
    modular = objective is LeidenObjective.Modularity
    plain = materialize(edges.where("src != dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w")), "plain")
    masses = strengths.select("id", (F.col("strength") if modular else F.lit(1.0)).alias("mass"))
    roots = materialize(star_forest(plain), "roots")
    plain, masses, placed = _condensed(plain, masses, roots, resolution)
    # a vertex is a row from itself to itself; no id is null, as pandas would make floats of them
    nodes = roots.join(masses, F.col("node") == F.col("id")).select("root", F.col("node").alias("src"), F.col("node").alias("dst"), F.col("mass").alias("w"))
    rows = plain.join(roots, F.col("src") == F.col("node")).select("root", "src", "dst", "w").unionByName(nodes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["src"] == pdf["dst"]
        vertex = pdf[own].sort_values("src")
        ids = vertex["src"].to_numpy()
        e = pdf[~own].sort_values(["src", "dst", "w"])
        a, b = np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy())
        part = leiden(len(ids), a.tolist(), b.tolist(), e["w"].tolist(), vertex["w"].tolist(), resolution, beta, n_iterations, seed + int(pdf["root"].iloc[0]))
        head: dict[int, int] = {}
        return pd.DataFrame({"id": ids, "root": [head.setdefault(c, int(i)) for i, c in zip(ids, part)]})

    found = rows.groupBy("root").applyInPandas(run, "id long, root long")
    if placed is not None:
        found = placed.join(found.withColumnRenamed("id", "_n"), F.col("part") == F.col("_n"), "left").select("id", F.coalesce("root", "part").alias("root")).unionByName(found.join(placed.select("id"), "id", "left_anti"))
    on = graph.vertices.join(found.withColumnRenamed("id", "_v"), F.col("id") == F.col("_v"), "left").select("id", F.coalesce("root", "id").alias("root"))
    return relabel(materialize(on, "communities"))


def _condensed(edges: DataFrame, masses: DataFrame, roots: DataFrame, resolution: float) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(edges, masses, placed): components of more than TASK_EDGES edges with connected parts of communities in place of vertices.

    ``placed`` (id, part) says where their vertices went; None without such a component.
    """
    def large(e: DataFrame) -> DataFrame:
        n = e.join(roots, F.col("src") == F.col("node")).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        return materialize(n.where(F.col("n") > TASK_EDGES).select("root"), "large")  # few: together no more than all edges

    placed, done = None, None
    while not (big := large(edges) if done is None else large(edges).join(done, "root", "left_anti")).isEmpty():
        inside = roots.join(F.broadcast(big), "root").select("node", "root")
        mine = materialize(edges.join(inside.select("node"), F.col("src") == F.col("node"), "left_semi"), "level")
        mass = materialize(masses.join(inside, F.col("id") == F.col("node")).select("id", "mass", "root"), "masses")
        comm = _moves(mine, mass, resolution)
        ends = mine.join(comm.select(F.col("id").alias("src"), F.col("comm").alias("a")), "src").join(comm.select(F.col("id").alias("dst"), F.col("comm").alias("b")), "dst")
        forest = materialize(star_forest(ends.where("a = b").select("src", "dst")), "parts")
        part = mass.join(forest, F.col("id") == F.col("node"), "left").select("id", "mass", forest["root"].alias("to")).withColumn("to", F.coalesce("to", "id"))
        part = materialize(part, "placed")
        n, m = part.agg(F.count(F.lit(1)), F.countDistinct("to")).first()
        at = lambda c, name: part.select(F.col("id").alias(c), F.col("to").alias(name))
        joined = mine.join(at("src", "a"), "src").join(at("dst", "b"), "dst").where("a != b")
        joined = joined.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w"))
        others = edges.join(inside.select("node"), F.col("src") == F.col("node"), "left_anti")
        edges = materialize(others.unionByName(joined), "edges")
        rest = masses.join(inside.select("node"), F.col("id") == F.col("node"), "left_anti")
        masses = materialize(rest.unionByName(part.groupBy(F.col("to").alias("id")).agg(F.sum("mass").alias("mass"))), "masses")
        moved = part.select("id", F.col("to").alias("part"))
        if placed is not None:
            before = placed.join(moved.withColumnRenamed("id", "_p").withColumnRenamed("part", "_to"), F.col("part") == F.col("_p"), "left")
            moved = before.select("id", F.coalesce("_to", "part").alias("part")).unionByName(moved.join(placed.select("id"), "id", "left_anti"))
        placed = materialize(moved, "moved")
        if m > SHRINK * n:  # as far as it goes
            done = big if done is None else done.unionByName(big)
    return edges, masses, placed


def _moves(edges: DataFrame, mass: DataFrame, resolution: float) -> DataFrame:
    """(id, comm): communities after ROUNDS of moves, half of the vertices at a time."""
    both = materialize(edges.select(F.col("src").alias("v"), F.col("dst").alias("u"), "w").unionByName(edges.select(F.col("dst").alias("v"), F.col("src").alias("u"), "w")), "both")
    comm = materialize(mass.select("id", "mass", F.col("id").alias("comm")), "comm")
    for k in range(ROUNDS):
        totals = comm.groupBy("comm").agg(F.sum("mass").alias("total"))
        near = both.join(comm.select(F.col("id").alias("u"), "comm"), "u").groupBy("v", "comm").agg(F.sum("w").alias("w"))
        own = comm.select(F.col("id").alias("v"), "comm", F.lit(0.0).alias("w"))
        options = near.unionByName(own).groupBy("v", "comm").agg(F.sum("w").alias("w")).join(totals, "comm")
        me = comm.select(F.col("id").alias("v"), "mass", F.col("comm").alias("mine"))
        stays = F.col("comm") == F.col("mine")
        gain = F.col("w") - resolution * F.col("mass") * (F.col("total") - F.when(stays, F.col("mass")).otherwise(0.0))
        scored = options.join(me, "v").select("v", "mass", "mine", F.struct(gain.alias("g"), stays.cast("int").alias("s"), (-F.col("comm")).alias("c")).alias("o"), F.when(stays, gain).alias("now"))
        best = scored.groupBy("v").agg(F.max("o").alias("o"), F.max("now").alias("now"), F.first("mass").alias("mass"), F.first("mine").alias("mine"))
        go = (F.col("o.g") > F.col("now") + 1e-12) & (F.pmod(F.xxhash64("v", F.lit(k)), F.lit(2)) == 0)
        new = best.select(F.col("v").alias("id"), "mass", F.when(go, -F.col("o.c")).otherwise(F.col("mine")).alias("comm"), go.alias("moved"))
        new = materialize(new, "comm")
        release(comm)
        comm = new.drop("moved")
        comm._kinsplit_path = new._kinsplit_path
        if new.where("moved").isEmpty() and k:
            break
    return comm.select("id", "comm")


def modularity(graph: CsrGraph, clusters: DataFrame, gamma: float = 1.0) -> float:
    """Newman's modularity of an assignment."""
    c = clusters.select("id", "cluster")
    inner = graph.sym.join(c.select(F.col("id").alias("v"), F.col("cluster").alias("a")), "v").join(c.select(F.col("id").alias("u"), F.col("cluster").alias("b")), "u").where("a = b").agg(F.sum("w")).first()[0] or 0.0
    s = graph.strengths().join(c, "id").groupBy("cluster").agg(F.sum("strength").alias("k")).agg(F.sum("k").alias("t"), F.sum(F.col("k") * F.col("k")).alias("q")).first()
    return inner / s["t"] - gamma * s["q"] / s["t"] ** 2 if s["t"] else 0.0
