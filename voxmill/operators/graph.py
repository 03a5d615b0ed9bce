"""Region graphs, edge costs and multicut solvers."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.plans.durable import connected_components, in_groups, materialize
from voxmill.volume import Volume


def region_adjacency(seg: Volume) -> DataFrame:
    """Edges (u, v), u < v, of labels that touch along an axis, and ``size``, the number of touching faces."""
    parts, seg = None, seg.dense()
    for a in seg.axes:
        ahead = seg.df.select(*[(F.col(x) - 1).alias(x) if x == a else F.col(x) for x in seg.axes], F.col("v").alias("w"))
        e = seg.df.join(ahead, list(seg.axes)).where("v <> w").select(F.least("v", "w").alias("u"), F.greatest("v", "w").alias("v"))
        parts = e if parts is None else parts.unionByName(e)
    return parts.groupBy("u", "v").agg(F.count(F.lit(1)).alias("size"))


def probabilities_to_costs(p: Column, beta: float = 0.5) -> Column:
    """``ln((1 - p') / p') + ln((1 - beta) / beta)`` with p' = 0.998 p + 0.001; high p repels."""
    q = 0.998 * p + 0.001
    return F.log((1 - q) / q) + F.log(F.lit((1 - beta) / beta))


def weighted_costs(edges: DataFrame, beta: float = 0.5, size: Column | None = None, population: Column | None = None, weighting_exponent: float = 1.0) -> DataFrame:
    """``edges`` (with ``p``) and their ``cost``, weighted by (size / greatest size) to an exponent.

    The greatest size is that of the edge's population, or of all: an aggregate that is joined
    back, never a window over all edges. A null population is one of its own.
    """
    cost = probabilities_to_costs(F.col("p"), beta)
    if size is None:
        return edges.withColumn("cost", cost)
    rows = edges.withColumns({"_s": size.cast("double"), "_g": F.lit(0) if population is None else population})
    most = rows.groupBy("_g").agg(F.max("_s").alias("_m")).withColumnRenamed("_g", "_h")
    both = rows.join(most, F.col("_g").eqNullSafe(F.col("_h")))
    return both.withColumn("cost", cost * F.pow(F.col("_s") / F.col("_m"), F.lit(float(weighting_exponent)))).select(*edges.columns, "cost")


def compute_edge_costs(edges: DataFrame, beta: float = 0.5, weighting_scheme: str | None = None, weighting_exponent: float = 1.0) -> DataFrame:
    """``edges`` (with ``p``, and ``size`` and ``is_z`` where the scheme needs them) with ``cost``.

    Schemes: None or 'none' (no weights), 'all' (by size), 'xyz' (by size, in-plane and z edges
    apart), 'z' (z edges by size, others with size 1).
    """
    if weighting_scheme in (None, "none"):
        return weighted_costs(edges, beta)
    if weighting_scheme not in ("all", "xyz", "z"):
        raise ValueError(f"unknown weighting scheme {weighting_scheme!r}")
    need = ["size"] + ["is_z"] * (weighting_scheme != "all")
    if missing := [c for c in need if c not in edges.columns]:
        raise ValueError(f"scheme {weighting_scheme!r} needs {missing}")
    size = F.when(F.col("is_z"), F.col("size")).otherwise(1) if weighting_scheme == "z" else F.col("size")
    return weighted_costs(edges, beta, size, F.col("is_z") if weighting_scheme == "xyz" else None, weighting_exponent)


# -- solvers on lists of (u, v, cost) ---------------------------------------------------------


def greedy_additive(edges: list[tuple]) -> dict:
    """Node -> cluster: contract the edge of highest cost while it is positive, adding parallel costs."""
    near: dict = {}
    for u, v, c in edges:
        if u != v:
            near.setdefault(u, {})[v] = near.setdefault(u, {}).get(v, 0.0) + c
            near.setdefault(v, {})[u] = near[u][v]
        else:
            near.setdefault(u, {})
    parent = {n: n for n in near}
    heap = [(-c, u, v) for u, m in near.items() for v, c in m.items() if u < v and c > 0]
    heapq.heapify(heap)
    while heap:
        c, u, v = heapq.heappop(heap)
        if near.get(u, {}).get(v) != -c:
            continue
        if len(near[u]) < len(near[v]):
            u, v = v, u
        parent[v] = u
        for w, x in near.pop(v).items():
            near[w].pop(v)
            if w != u:
                near[u][w] = near[w][u] = near[u].get(w, 0.0) + x
                if near[u][w] > 0:
                    heapq.heappush(heap, (-near[u][w], min(u, w), max(u, w)))

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    return {n: find(n) for n in parent}


def greedy_fixation(edges: list[tuple]) -> dict:
    """Like ``greedy_additive`` in the order of absolute cost; repulsive edges forbid a later contraction."""
    parent: dict = {}
    apart: dict = {}

    def find(n):
        parent.setdefault(n, n)
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for u, v, c in sorted(edges, key=lambda e: (-abs(e[2]), e[0], e[1])):
        a, b = find(u), find(v)
        if a == b:
            continue
        if c <= 0:
            apart.setdefault(a, set()).add(b)
            apart.setdefault(b, set()).add(a)
        elif b not in apart.get(a, ()):
            parent[b] = a
            for w in apart.pop(b, ()):
                apart[w].discard(b)
                apart[w].add(a)
                apart.setdefault(a, set()).add(w)
    return {n: find(n) for n in list(parent)}


def kernighan_lin(edges: list[tuple], start: dict | None = None) -> dict:
    """Improve a clustering until neither single moves, nor move sequences of two clusters, nor their union make the cut cheaper.

    Of each pair of neighbouring clusters, and of each cluster and an empty one, every node moves
    once to the other side, the best move first even if it makes the cut dearer; the best beginning
    of the sequence is kept, or the union if that gains more. Every change lowers the cut, so it ends.
    """
    near: dict = {}
    for u, v, c in edges:
        if u != v:
            near.setdefault(u, {})[v] = near.setdefault(u, {}).get(v, 0.0) + c
            near.setdefault(v, {})[u] = near[u][v]
        else:
            near.setdefault(u, {})
    given = dict(start) if start is not None else greedy_additive(edges)
    least: dict = {}
    for n in sorted(near):
        least.setdefault(given[n], len(least))
    label = {n: least[given[n]] for n in near}
    fresh, slack = len(least), 1e-9
    members: dict = {}
    for n in sorted(near):
        members.setdefault(label[n], set()).add(n)

    def move(n, k):
        members[label[n]].discard(n)
        if not members[label[n]]:
            del members[label[n]]
        label[n] = k
        members.setdefault(k, set()).add(n)

    def single_moves() -> set:
        nonlocal fresh
        touched: set = set()
        todo = sorted(near)
        while todo:
            again: set = set()
            for n in todo:
                pull: dict = {}
                for m, c in near[n].items():
                    pull[label[m]] = pull.get(label[m], 0.0) + c
                own = pull.pop(label[n], 0.0)
                best, gain = None, slack
                for k in sorted(pull):
                    if pull[k] - own > gain:
                        best, gain = k, pull[k] - own
                if -own > gain:
                    best, fresh = fresh, fresh + 1
                if best is not None:
                    touched |= {label[n], best}
                    move(n, best)
                    again |= {n, *near[n]}
            todo = sorted(again)
        return touched

    def improve(a, b) -> bool:
        """The best of: a beginning of the move sequence between a and b, and their union."""
        both = sorted(members[a] | members.get(b, set()))
        side = {n: label[n] for n in both}
        gain = {n: sum(c if side[m] != side[n] else -c for m, c in near[n].items() if m in side) for n in both}
        joined = sum(c for n in members[a] for m, c in near[n].items() if side.get(m) == b) if b in members else 0.0
        heap = [(-g, n) for n, g in gain.items()]
        heapq.heapify(heap)
        moves, total, best, cut = [], 0.0, slack, 0
        free = set(both)
        while heap:
            g, n = heapq.heappop(heap)
            if n not in free or -g != gain[n]:
                continue
            free.discard(n)
            total += gain[n]
            moves.append(n)
            side[n] = b if side[n] == a else a
            for m, c in near[n].items():
                if m in free:
                    gain[m] += 2 * c if side[m] != side[n] else -2 * c
                    heapq.heappush(heap, (-gain[m], m))
            if total > best:
                best, cut = total, len(moves)
        if joined > best:
            for n in list(members[b]):
                move(n, a)
            return True
        for n in moves[:cut]:
            move(n, b if label[n] == a else a)
        return cut > 0

    single_moves()
    dirty = set(members)
    while dirty:
        pairs = {(min(label[u], label[v]), max(label[u], label[v])) for u in near for v in near[u] if label[u] != label[v]}
        changed: set = set()
        for a, b in sorted(pairs):
            if a in members and b in members and {a, b} & (dirty | changed) and improve(a, b):
                changed |= {a, b}
        for a in sorted(members):
            if a in dirty | changed and len(members[a]) > 1:
                fresh += 1
                if improve(a, fresh - 1):
                    changed |= {a, fresh - 1}
        dirty = (changed | single_moves()) & set(members) if changed else set()
    return label


SOLVERS = {"kernighan-lin": kernighan_lin, "greedy-additive": greedy_additive, "greedy-fixation": greedy_fixation}


def _numbered(label: dict) -> list[tuple]:
    least: dict = {}
    for n in sorted(label):
        least.setdefault(label[n], n)
    return [(n, least[label[n]]) for n in sorted(label)]


def _solve_parts(edges: DataFrame, solver) -> DataFrame:
    """(node, cluster): components of attractive edges are found in Spark and solved apart, in parallel.

    Clusters of two such components are only joined by edges of no positive cost, so neither
    an optimal cut nor a solver that joins clusters for gain ever unites them.
    """
    flat = materialize(edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"), F.col("cost").cast("double").alias("cost")), "multicut")
    roots = materialize(connected_components(flat.where("cost > 0").select("u", "v")), "multicut_roots")
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}"))
    inner = flat.join(of("u"), "u").join(of("v"), "v").where("r_u = r_v").select(F.col("r_u").alias("root"), "u", "v", "cost")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_numbered(solver(list(zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["cost"].tolist())))), columns=["node", "cluster"], dtype="int64")

    solved = in_groups(inner, "root", ["u", "v"], run, "node bigint, cluster bigint")
    nodes = flat.select(F.col("u").alias("node")).union(flat.select("v")).distinct()
    return nodes.join(solved, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def multicut_gaec(edges: DataFrame) -> DataFrame:
    """(node, cluster) by greedy additive edge contraction; a cluster is named after its least node."""
    return _solve_parts(edges, greedy_additive)


def multicut_kernighan_lin(edges: DataFrame, warmstart: bool = True) -> DataFrame:
    """(node, cluster) by Kernighan-Lin moves and unions, from the greedy solution or from single nodes."""
    return _solve_parts(edges, kernighan_lin if warmstart else lambda e: kernighan_lin(e, {n: n for u, v, _ in e for n in (u, v)}))


def multicut_decomposition(edges: DataFrame, internal_solver: str = "kernighan-lin") -> DataFrame:
    """(node, cluster) by a solver of choice on each component of attractive edges."""
    if internal_solver not in SOLVERS:
        raise ValueError(f"unknown solver {internal_solver!r}")
    return _solve_parts(edges, SOLVERS[internal_solver])
