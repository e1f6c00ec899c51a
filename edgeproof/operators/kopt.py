"""k-opt leaves: can every way to close a path system outside it be beaten inside it without the target edge?

The cost matrix of tasks and templates is relational. The search inside one leaf is sequential by definition (first improvement in a fixed
order, one witness covering many matchings), touches a few dozen nodes, and runs in an Arrow function, one leaf a row.
"""

from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeproof.functions import fnv
from edgeproof.functions.distance import plain

from . import catalogs
from .paths import Paths, normalize

Edge = tuple[int, int]


def edge(a: int, b: int) -> Edge:
    return (a, b) if a < b else (b, a)


@dataclass(frozen=True)
class Options:
    """Largest k; most deletion sets for a matching (0: all); most blocks of the exact search (0: none)."""

    max_k: int = 5
    max_deletion_sets: int = 0
    exact_blocks: int = 0


@dataclass(frozen=True)
class Metric:
    """Distances of the nodes of one leaf."""

    xy: dict[int, tuple[int, int]]
    kind: str = "EUC_2D"

    def __call__(self, a: int, b: int) -> int:
        return plain(*self.xy[a], *self.xy[b], self.kind)

    def total(self, edges: list[Edge]) -> int:
        return sum(self(a, b) for a, b in edges)


@dataclass
class Witness:
    k: int
    deleted_cost: int
    added_cost: int
    deleted: list[Edge]
    added: list[Edge]
    inside: tuple[int, ...]


@dataclass
class Search:
    status: str
    reason: str = ""
    witness: Witness | None = None
    deletion_sets: int = 0
    matchings: int = 0
    states: int = 0


def cycle(nodes: list[int], edges: set[Edge]) -> list[int] | None:
    """The tour that the edges make of the nodes, from the least node towards its smaller neighbour; None if they make none."""
    if len(nodes) < 3 or len(edges) != len(nodes):
        return None
    near: dict[int, list[int]] = {n: [] for n in nodes}
    for a, b in edges:
        if a not in near or b not in near:
            return None
        near[a].append(b)
        near[b].append(a)
    if len(near) != len(nodes) or any(len(x) != 2 for x in near.values()):
        return None
    start = min(nodes)
    tour, before, now = [start], start, min(near[start])
    while now != start:
        tour.append(now)
        a, b = near[now]
        before, now = now, b if a == before else a
        if len(tour) > len(nodes):
            return None
    return tour if len(tour) == len(nodes) else None


@dataclass
class Context:
    """A path system closed by an outside matching: its tour, the path edges that may be deleted (target first), and all edges."""

    nodes: list[int]
    ends: list[int]
    path_edges: set[Edge]
    outside_edges: set[Edge]
    tour: list[int]
    places: list[int]

    def at(self, place: int) -> Edge:
        return edge(self.tour[place], self.tour[(place + 1) % len(self.tour)])


def context(paths: Paths, mates: tuple[int, ...], required: Edge | None) -> Context | str:
    """The closed system, or why there is none."""
    ok, _, normal, _ = normalize(paths, 1 << 31)
    if not ok or normal != paths or len(paths) > catalogs.MOST_PATHS:
        return "no sound path system"
    m = len(paths)
    if len(mates) != 2 * m or any(not 0 <= x < 2 * m or x == i or mates[x] != i for i, x in enumerate(mates)):
        return "no outside matching"
    ends = [n for p in paths for n in (p[0], p[-1])]
    inner = {edge(a, b) for p in paths for a, b in zip(p, p[1:], strict=False)}
    outer = [edge(ends[i], ends[x]) for i, x in enumerate(mates) if i < x]
    if len({*outer} | inner) != len(outer) + len(inner):
        return "outside matching repeats an edge"
    nodes = [n for p in paths for n in p]
    tour = cycle(nodes, inner | {*outer})
    if tour is None:
        return "no local tour"
    out = Context(nodes, ends, inner, {*outer}, tour, [])
    places = [i for i in range(len(tour)) if out.at(i) in inner]
    if required is not None:
        first = next((j for j, i in enumerate(places) if out.at(i) == edge(*required)), None)
        if first is None:
            return "required edge is no path edge"
        places = places[first:] + places[:first]
    out.places = places
    return out


def inside_of(c: Context, mates: tuple[int, ...], tour: list[int]) -> tuple[int, ...] | None:
    """How a tour joins the ends inside: ends in tour order, in pairs that the outside matching does not join."""
    name = {n: i for i, n in enumerate(c.ends)}
    order = [name[n] for n in tour if n in name]
    if len(order) != len(mates):
        return None
    if mates[order[0]] == order[1]:
        order = order[1:] + order[:1]
    out = [0] * len(mates)
    for a, b in zip(order[::2], order[1::2], strict=True):
        out[a], out[b] = b, a
    return tuple(out) if catalogs.one_tour(mates, tuple(out)) else None


def reconnect(c: Context, d: Metric, mates: tuple[int, ...], places: list[int], forms: tuple[tuple[int, ...], ...]) -> tuple[Witness | None, int]:
    """The first template that closes a strictly shorter tour after deleting these places (in tour order), and how many were tried."""
    ports = [n for i in places for n in (c.tour[i], c.tour[(i + 1) % len(c.tour)])]
    deleted = sorted(c.at(i) for i in places)
    rest, cost = (c.path_edges | c.outside_edges) - {*deleted}, d.total(deleted)
    for tried, form in enumerate(forms, 1):
        added = sorted(edge(ports[a], ports[b]) for a, b in enumerate(form) if a < b)
        if any(a == b for a, b in added) or len({*added}) < len(added) or rest & {*added} or {*deleted} & {*added}:
            continue
        new = d.total(added)
        if new >= cost:
            continue
        tour = cycle(c.nodes, rest | {*added})
        if tour is None:
            continue
        joined = inside_of(c, mates, tour)
        if joined is not None:
            return Witness(len(places), cost, new, deleted, added, joined), tried
    return None, len(forms)


#: Cost of what cannot be.
NEVER = 1 << 60
#: Deletion sets whose costs are worked out at once.
BLOCK = 2048


@cache
def _forms(k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ports that each template of k joins: (templates, k) each."""
    pairs = [[(a, b) for a, b in enumerate(f) if a < b] for f in catalogs.templates(k)]
    both = np.array(pairs, np.int64)
    return both[:, :, 0], both[:, :, 1]


@cache
def _sets(places: int, k: int) -> np.ndarray:
    """Anchored k-subsets of so many places in lexicographic order; the first place is in all."""
    return np.array([(0, *more) for more in combinations(range(1, places), k - 1)], np.int64).reshape(-1, k)


def distances(d: Metric, nodes: list[int]) -> np.ndarray:
    return np.array([[d(a, b) if a != b else 0 for b in nodes] for a in nodes], np.int64)


def find_witness(paths: Paths, d: Metric, mates: tuple[int, ...], required: Edge | None, o: Options) -> Search:
    """Deletion sets by size, then lexicographic over the path edges from the required one on, which every set holds; sizes stay below their number.

    Costs of all templates of a block of deletion sets are one array; only those that are shorter are rebuilt and judged, in order.
    """
    if not 3 <= o.max_k <= 5:
        return Search("invalid", "max_k must be from 3 to 5")
    c = context(paths, mates, required)
    if isinstance(c, str):
        return Search("invalid", c)
    out = Search("no-improvement", "no strictly shorter reconnection")
    far, size = distances(d, c.tour), len(c.tour)
    places = np.array(c.places, np.int64)
    for k in range(3, min(o.max_k, len(c.places) - 1) + 1):
        forms, (one, two), sets = catalogs.templates(k), _forms(k), _sets(len(c.places), k)
        most = min(len(sets), o.max_deletion_sets - out.deletion_sets) if o.max_deletion_sets else len(sets)
        for s in range(0, most, BLOCK):
            at = np.sort(places[sets[s : min(s + BLOCK, most)]], axis=1)
            ports = np.stack([at, (at + 1) % size], axis=2).reshape(len(at), 2 * k)
            added = far[ports[:, one], ports[:, two]].sum(axis=2)
            shorter = added < far[at, (at + 1) % size].sum(axis=1)[:, None]
            for i, t in np.argwhere(shorter).tolist():
                found, _ = reconnect(c, d, mates, at[i].tolist(), forms[t : t + 1])
                if found is not None:
                    out.matchings += i * len(forms) + t + 1
                    out.deletion_sets += i + 1
                    out.status, out.reason, out.witness = "improved", "strictly shorter reconnection", found
                    return out
            out.deletion_sets += len(at)
            out.matchings += len(at) * len(forms)
        if most < len(sets):
            out.status, out.reason = "unresolved", "deletion sets used up"
            return out
    return out


def exact_tour(paths: Paths, d: Metric, mates: tuple[int, ...], required: Edge | None, most: int) -> Search:
    """The shortest tour that keeps the outside edges and leaves the required one out, over blocks: a subset dynamic programme with fixed first block."""
    if not 1 <= most <= 18:
        return Search("unresolved", "blocks must be from 1 to 18")
    c = context(paths, mates, required)
    if isinstance(c, str):
        return Search("invalid", c)
    pairs = [(c.ends[i], c.ends[x]) for i, x in enumerate(mates) if i < x]
    single = sorted({*c.nodes} - {*c.ends})
    ways = [[(a, b), (b, a)] for a, b in pairs] + [[(n, n)] for n in single]  # (entry, exit) of each block and direction
    if len(ways) < 2:
        return Search("invalid", "fewer than two blocks")
    if len(ways) > most:
        return Search("unresolved", "more blocks than allowed")
    ban, n = None if required is None else edge(*required), len(ways)
    # a way is a column: block and direction; costs from the exit of each to the entry of each
    column = [(b, way) for b in range(n) for way in range(len(ways[b]))]
    block = np.array([b for b, _ in column])
    step = np.array([[NEVER if block[i] == block[j] or edge(ways[a][x][1], ways[b][y][0]) == ban else d(ways[a][x][1], ways[b][y][0]) for j, (b, y) in enumerate(column)] for i, (a, x) in enumerate(column)], np.int64)
    # masks leave out the first block, which is always there, forward
    best = np.full((1 << (n - 1), len(column)), NEVER, np.int64)
    came = np.zeros(best.shape, np.int8)
    best[0, 0] = 0
    masks, ones = np.arange(1 << (n - 1)), np.bitwise_count(np.arange(1 << (n - 1), dtype=np.uint32))
    for layer in range(n - 1):
        own = masks[ones == layer]
        for j in range(1, len(column)):
            if block[j] == 0:
                continue
            to = own[own >> (block[j] - 1) & 1 == 0]
            cost = best[to] + step[:, j]
            first = cost.argmin(axis=1)
            least = cost[np.arange(len(to)), first]
            to = to | 1 << (block[j] - 1)
            best[to, j], came[to, j] = np.minimum(least, NEVER), first
    states = int((best < NEVER).sum())
    enter = ways[0][0][0]
    last = best[-1] + np.array([NEVER if ban is not None and edge(ways[b][x][1], enter) == ban else d(ways[b][x][1], enter) for b, x in column])
    j = int(last.argmin())
    if last[j] >= NEVER:
        return Search("no-improvement", "no tour without the required edge", states=states)
    if last[j] >= d.total(sorted(c.path_edges)):
        return Search("no-improvement", "no strictly shorter tour", states=states)
    order, mask = [], len(masks) - 1
    while True:
        order.append((0, *column[j]))
        if block[j] == 0:
            break
        j, mask = int(came[mask, j]), mask ^ 1 << (block[j] - 1)
    order.reverse()
    steps = [edge(ways[a[1]][a[2]][1], ways[b[1]][b[2]][0]) for a, b in zip(order, order[1:] + order[:1], strict=True)]
    edges = c.outside_edges | {*steps}
    if any(a == b for a, b in steps) or len(edges) < len(c.outside_edges) + len(steps):
        return Search("invalid", "rebuilt tour repeats an edge", states=states)
    tour = cycle(c.nodes, edges)
    whole = c.path_edges | c.outside_edges
    deleted, added = sorted(whole - edges), sorted(edges - whole)
    joined = tour and inside_of(c, mates, tour)
    if not joined or len(deleted) < 2 or len(deleted) != len(added):
        return Search("invalid", "rebuilt tour is no exchange", states=states)
    w = Witness(len(deleted), d.total(deleted), d.total(added), deleted, added, joined)
    if verify_witness(paths, d, mates, required, w) != "ok":
        return Search("invalid", "rebuilt tour does not verify", states=states)
    return Search("improved", "strictly shorter tour", w, states=states)


def verify_witness(paths: Paths, d: Metric, mates: tuple[int, ...], required: Edge | None, w: Witness) -> str:
    """"ok" or what is wrong: counts, edges deleted that are no path edges, the required one kept, edges added that are there, costs, no single tour, another inside matching."""
    c = context(paths, mates, required)
    if isinstance(c, str):
        return c
    if not 2 <= w.k <= len(c.path_edges) or len(w.deleted) != w.k or len(w.added) != w.k:
        return "counts"
    gone, new = {*w.deleted}, {*w.added}
    if len(gone) < w.k or not gone <= c.path_edges:
        return "deleted edges"
    if required is not None and edge(*required) not in gone:
        return "required edge kept"
    rest = (c.path_edges | c.outside_edges) - gone
    if len(new) < w.k or new & rest or new & gone or any(a >= b or a not in c.nodes or b not in c.nodes for a, b in new):
        return "added edges"
    if d.total(sorted(gone)) != w.deleted_cost or d.total(sorted(new)) != w.added_cost or w.added_cost >= w.deleted_cost:
        return "costs"
    tour = cycle(c.nodes, rest | new)
    if tour is None:
        return "no tour"
    return "ok" if inside_of(c, mates, tour) == tuple(w.inside) else "inside matching"


@dataclass
class Leaf:
    """A leaf's proof: a witness for each outside matching that none before it covers."""

    proven: bool
    reason: str
    paths_hash: str
    table_hash: str
    path_count: int
    outside_count: int
    deletion_sets: int = 0
    matchings: int = 0
    records: list[tuple[int, Witness]] = field(default_factory=list)


def _covers(m: int, inside: tuple[int, ...]) -> set[int]:
    if m <= catalogs.TABLE_PATHS:
        return set(catalogs.compatible(m)[catalogs.inside(m).index(inside)])
    return {i for i, o in enumerate(catalogs.outside(m)) if catalogs.one_tour(o, inside)}


def prove_leaf(paths: Paths, d: Metric, required: Edge | None, o: Options) -> Leaf:
    m = len(paths)
    if not 1 <= m <= catalogs.MOST_PATHS:
        return Leaf(False, "path count", fnv.paths_hash(paths), "0" * 16, m, 0)
    out = Leaf(False, "", fnv.paths_hash(paths), catalogs.table_hash(m) if m <= catalogs.TABLE_PATHS else "0" * 16, m, len(catalogs.outside(m)))
    covered: set[int] = set()
    for i, mates in enumerate(catalogs.outside(m)):
        if i in covered:
            continue
        got = find_witness(paths, d, mates, required, o)
        out.deletion_sets += got.deletion_sets
        out.matchings += got.matchings
        if got.status != "improved" and o.exact_blocks:
            exact = exact_tour(paths, d, mates, required, o.exact_blocks)
            got = exact if exact.status == "improved" else Search(exact.status, f"{got.reason}; {exact.reason}")
        if got.status != "improved" or verify_witness(paths, d, mates, required, got.witness) != "ok":
            out.reason = f"outside {i}: {got.reason}"
            return out
        covered |= _covers(m, got.witness.inside)
        if i not in covered:
            out.reason = "witness does not cover its own matching"
            return out
        out.records.append((i, got.witness))
    out.proven, out.reason = True, "every outside matching is beaten"
    return out


def verify_leaf(paths: Paths, d: Metric, required: Edge | None, leaf: Leaf) -> str:
    """"ok" or what is wrong with a leaf proof: hashes, counts, order of records, a witness, a matching left open."""
    m = len(paths)
    if not leaf.proven or not 1 <= m <= catalogs.MOST_PATHS or leaf.path_count != m or leaf.outside_count != len(catalogs.outside(m)):
        return "counts"
    if leaf.paths_hash != fnv.paths_hash(paths) or (m <= catalogs.TABLE_PATHS and leaf.table_hash != catalogs.table_hash(m)):
        return "hashes"
    covered: set[int] = set()
    for i, w in leaf.records:
        if not 0 <= i < leaf.outside_count or i in covered:
            return "records"
        if (why := verify_witness(paths, d, catalogs.outside(m)[i], required, w)) != "ok":
            return why
        covered |= _covers(m, tuple(w.inside))
    return "ok" if len(covered) == leaf.outside_count else "matching left open"


# ---- Arrow functions ----

WITNESS = "struct<k:int,deleted_cost:bigint,added_cost:bigint,deleted:array<struct<u:int,v:int>>,added:array<struct<u:int,v:int>>,inside:array<int>>"
LEAF = f"struct<proven:boolean,reason:string,paths_hash:string,table_hash:string,path_count:int,outside_count:bigint,deletion_sets:bigint,matchings:bigint,records:array<struct<source:bigint,witness:{WITNESS}>>>"


def _row(w: Witness) -> dict:
    pairs = lambda es: [{"u": a, "v": b} for a, b in es]
    return {"k": w.k, "deleted_cost": w.deleted_cost, "added_cost": w.added_cost, "deleted": pairs(w.deleted), "added": pairs(w.added), "inside": list(w.inside)}


def _witness(r: dict) -> Witness:
    pairs = lambda es: [(int(e["u"]), int(e["v"])) for e in es]
    return Witness(int(r["k"]), int(r["deleted_cost"]), int(r["added_cost"]), pairs(r["deleted"]), pairs(r["added"]), tuple(int(x) for x in r["inside"]))


def leaf_of(r: dict) -> Leaf:
    return Leaf(bool(r["proven"]), r["reason"], r["paths_hash"], r["table_hash"], int(r["path_count"]), int(r["outside_count"]), int(r["deletion_sets"]), int(r["matchings"]), [(int(x["source"]), _witness(x["witness"])) for x in r["records"]])


def leaf_row(f: Leaf) -> dict:
    return {"proven": f.proven, "reason": f.reason, "paths_hash": f.paths_hash, "table_hash": f.table_hash, "path_count": f.path_count, "outside_count": f.outside_count, "deletion_sets": f.deletion_sets, "matchings": f.matchings, "records": [{"source": i, "witness": _row(w)} for i, w in f.records]}


def _metric(places, kind: str) -> Metric:
    return Metric({int(p["id"]): (int(p["x"]), int(p["y"])) for p in places}, kind)


def _paths(p) -> Paths:
    return [[int(x) for x in q] for q in p]


def leaves(paths: Column, places: Column, u: Column, v: Column, options: Options, kind: str = "EUC_2D") -> Column:
    """The leaf proof of each path system for target uv; places: array of (id, x, y) of its nodes."""

    def run(p: pd.Series, xy: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = [leaf_row(prove_leaf(_paths(q), _metric(z, kind), edge(int(s), int(t)), options)) for q, z, s, t in zip(p, xy, a, b, strict=True)]
        return pd.DataFrame(out, columns=["proven", "reason", "paths_hash", "table_hash", "path_count", "outside_count", "deletion_sets", "matchings", "records"])

    return F.pandas_udf(run, LEAF)(paths, places, u, v)


def leaf_verdicts(paths: Column, places: Column, u: Column, v: Column, leaf: Column, kind: str = "EUC_2D") -> Column:
    """"ok", or what is wrong with each leaf proof."""

    def run(p: pd.Series, xy: pd.Series, a: pd.Series, b: pd.Series, f: pd.DataFrame) -> pd.Series:
        rows = f.to_dict("records")
        return pd.Series([verify_leaf(_paths(q), _metric(z, kind), edge(int(s), int(t)), leaf_of(r)) for q, z, s, t, r in zip(p, xy, a, b, rows, strict=True)])

    return F.pandas_udf(run, "string")(paths, places, u, v, leaf)


# ---- cost matrix ----


def template_costs(tasks: DataFrame, points: DataFrame, forms: DataFrame, kind: str = "EUC_2D", fast: bool = True) -> DataFrame:
    """(g, task_id, k, template_id, added_cost): cost of each template for each task; null where it adds a loop, repeats an edge, or brings a deleted one back.

    tasks: (g, task_id, k, ports array<int> of 2k nodes). The catalog has a few hundred rows and is broadcast; pairs of ports become rows, and
    a pair's distance comes from the points.
    """
    from edgeproof.functions.distance import distance

    pair = forms.select("k", "template_id", F.posexplode("mates").alias("a", "b")).where("a < b")
    rows = tasks.join(F.broadcast(pair), "k").select("g", "task_id", "k", "template_id", "ports", F.least(F.expr("ports[a]"), F.expr("ports[b]")).alias("p"), F.greatest(F.expr("ports[a]"), F.expr("ports[b]")).alias("q"))
    at = lambda n, x: points.select("g", F.col("id").alias(n), F.col("ix").alias(f"{x}x"), F.col("iy").alias(f"{x}y"))
    rows = rows.join(at("p", "s"), ["g", "p"]).join(at("q", "t"), ["g", "q"])
    taken = F.exists(F.sequence(F.lit(0), F.col("k") - 1), lambda i: (F.least(F.element_at("ports", 2 * i + 1), F.element_at("ports", 2 * i + 2)) == F.col("p")) & (F.greatest(F.element_at("ports", 2 * i + 1), F.element_at("ports", 2 * i + 2)) == F.col("q")))
    rows = rows.withColumn("bad", (F.col("p") == F.col("q")) | taken).withColumn("d", distance(F.col("sx"), F.col("sy"), F.col("tx"), F.col("ty"), kind, fast))
    got = rows.groupBy("g", "task_id", "k", "template_id").agg(F.sum("d").alias("cost"), F.bool_or("bad").alias("bad"), F.count_distinct("p", "q").alias("n"))
    return got.select("g", "task_id", "k", "template_id", F.when(~F.col("bad") & (F.col("n") == F.col("k")), F.col("cost")).alias("added_cost"))


def first_improving(costs: DataFrame, tasks: DataFrame) -> DataFrame:
    """(g, task_id, template_id): the first template of each task (with deleted_cost) that costs less than what it deletes; null if none does."""
    t = tasks.select("g", "task_id", "deleted_cost").join(costs, ["g", "task_id"], "left")
    return t.groupBy("g", "task_id").agg(F.min(F.when(F.col("added_cost") < F.col("deleted_cost"), F.col("template_id"))).alias("template_id"))
