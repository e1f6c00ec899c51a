"""Hamilton-Tutte search, level by level, for all targets and all their root candidates at once.

A state is a path system that an adversary's replies have forced; a leaf proof refutes it, or a move all of whose replies lead to refuted
states (a reply without a sound system is refuted by itself). Levels are DataFrames keyed by (g, target, sid); sid is the array of candidate
rank, then move and reply numbers, so it is an order and an address. Truth goes back up by AND over replies and OR over moves.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeproof.plans.cut import cut

from . import ht, kopt, paths
from .graph import Graph


@dataclass(frozen=True)
class Options:
    """Counts; 0 is no limit, but for depth and for moves, where it is none of them."""

    root: ht.RootOptions = ht.RootOptions()
    leaf: kopt.Options = kopt.Options()
    depth: int = 2
    states: int = 100_000
    replies: int = 1_000_000
    replies_per_move: int = 10_000
    point: int = 3
    end: int = 3
    point_moves: bool = True
    end_moves: bool = True


#: A state's key.
KEY = ["g", "target", "sid"]
_PAIR = "struct<center:int,first:int,second:int>"
_EDGE = "struct<u:int,v:int>"


@dataclass
class Wave:
    """states: KEY, depth, paths, leaf. moves: KEY, ord, type, first, second. replies: KEY, ord, reply, pair1, pair2, edge, child (a sid; null if infeasible)."""

    graph: Graph
    targets: DataFrame
    options: Options
    states: list[DataFrame] = field(default_factory=list)
    moves: list[DataFrame] = field(default_factory=list)
    replies: list[DataFrame] = field(default_factory=list)


def with_leaves(graph: Graph, states: DataFrame, targets: DataFrame, o: kopt.Options) -> DataFrame:
    """States with the leaf proof of each; equal systems of a target are searched once."""
    once = states.select("g", "target", "paths").distinct()
    node = once.select("g", "target", "paths", F.explode(F.flatten("paths")).alias("id"))
    node = node.join(graph.points.select("g", "id", "ix", "iy"), ["g", "id"])
    place = node.groupBy("g", "target", "paths").agg(F.collect_list(F.struct("id", F.col("ix").alias("x"), F.col("iy").alias("y"))).alias("places"))
    work = place.join(targets.select("g", "target", "u", "v"), ["g", "target"])
    done = work.select("g", "target", "paths", kopt.leaves(F.col("paths"), F.col("places"), F.col("u"), F.col("v"), o, graph.kind).alias("leaf"))
    return states.join(done, ["g", "target", "paths"])


def _children(rows: DataFrame, more: F.Column, tail: list) -> DataFrame:
    """Rows of replies with the child's paths (null if infeasible) and its sid."""
    grown = rows.withColumn("child_paths", paths.grown(F.col("paths"), more))
    return grown.withColumn("child", F.when(F.col("child_paths").isNotNull(), F.concat("sid", F.array(*[F.col(c).cast("int") for c in tail]))))


def _none(kind: str) -> F.Column:
    return F.lit(None).cast(kind)


def root_moves(graph: Graph, targets: DataFrame, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States of all root candidates within the limits, their c, d moves, and the joint replies with the children's paths (cut)."""
    cds = cut(ht.cd_candidates(graph, targets, o.root))
    for most in (o.root.reply_combinations, o.replies_per_move):
        if most:
            cds = cds.where(F.col("product") <= most)
    root = cds.select("g", "target", F.array(F.col("rank").cast("int")).alias("sid"), "c", "d").join(targets.select("g", "target", "u", "v"), ["g", "target"])
    states = root.select(*KEY, F.lit(-1).alias("depth"), F.array(F.array(F.least("u", "v"), F.greatest("u", "v"))).alias("paths"), _none(kopt.LEAF).alias("leaf"))
    moves = root.select(*KEY, F.lit(0).alias("ord"), F.lit("cd").alias("type"), F.col("c").alias("first"), F.col("d").alias("second"))
    r = ht.root_replies(graph, cds, targets).withColumn("sid", F.array(F.col("rank").cast("int"))).join(states.select(*KEY, "paths"), KEY)
    r = _children(r, F.array(F.array("c_first", "c", "c_second"), F.array("d_first", "d", "d_second")), ["reply"])
    pair = lambda n: F.struct(F.col(n).alias("center"), F.col(f"{n}_first").alias("first"), F.col(f"{n}_second").alias("second"))
    r = cut(r.select(*KEY, F.lit(0).alias("ord"), "reply", pair("c").alias("pair1"), pair("d").alias("pair2"), _none(_EDGE).alias("edge"), "child", "child_paths"))
    return states, moves, r


def point_order(graph: Graph, targets: DataFrame, o: Options) -> DataFrame | None:
    """(g, target, node, rank): the nodes that point moves choose from; None if there are no moves."""
    # a state of depth d holds up to 8 + 3d nodes, which are passed over
    most = o.root.neighborhood and o.root.neighborhood + 8 + 3 * o.depth
    return cut(ht.midpoint_rank(graph, targets, o.root.candidate_degree, most).select("g", "target", "node", "rank")) if o.depth else None


def search(graph: Graph, targets: DataFrame, o: Options = Options()) -> Wave:
    """The whole search space of the targets within the options; nothing stops at a first success, so results do not hang on order. ``lazy`` has the search that stops."""
    wave = Wave(graph, targets, o)
    states, moves, r = root_moves(graph, targets, o)
    wave.states.append(states)
    wave.moves.append(moves)
    wave.replies.append(r.drop("child_paths"))
    near = point_order(graph, targets, o)
    for depth in range(o.depth + 1):
        level = r.where("child is not null").select("g", "target", F.col("child").alias("sid"), F.lit(depth).alias("depth"), F.col("child_paths").alias("paths"))
        level = cut(with_leaves(graph, level, targets, o.leaf).select(*KEY, "depth", "paths", "leaf"))
        wave.states.append(level)
        open_ = level.where(~F.col("leaf.proven"))
        if depth == o.depth or open_.isEmpty():
            break
        m, r = expansion(graph, targets, o, open_.select(*KEY, "paths"), near)
        wave.moves.append(m)
        wave.replies.append(r.drop("child_paths"))
    return wave


def expansion(graph: Graph, targets: DataFrame, o: Options, states: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point moves, then end moves, of open states (KEY, paths), and their replies with the children's paths; both cut."""
    by = Window.partitionBy(*KEY)
    allowed = (lambda n: n <= o.replies_per_move) if o.replies_per_move else (lambda n: n >= 0)
    none = states.limit(0)
    moves, replies = none.select(*KEY, F.lit(0).alias("ord"), F.lit("").alias("type"), F.lit(0).alias("first"), F.lit(0).alias("second")), None
    vacuous = None
    if o.point_moves:
        c = states.join(near, ["g", "target"]).where(~F.array_contains(F.flatten("paths"), F.col("node")))
        if o.root.neighborhood:
            c = c.withColumn("k", F.row_number().over(by.orderBy("rank"))).where(F.col("k") <= o.root.neighborhood).drop("k")
        ham = cut(ht.hamilton_replies(graph, c.select("g", "target", F.col("node").alias("center")), targets))
        n = ham.groupBy("g", "target", F.col("center").alias("node")).agg(F.count("*").alias("n"))
        c = c.join(n, ["g", "target", "node"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
        c = c.withColumn("ord", F.row_number().over(by.orderBy("n", "node")) - 1)
        c = (c.where(F.col("ord") < o.point) if o.point else c).where(allowed(F.col("n")))
        rows = c.select(*KEY, "paths", "ord", F.col("node").alias("center")).join(ham, ["g", "target", "center"])
        rows = _children(rows, F.array(F.array("first", "center", "second")), ["ord", "reply"])
        pair = F.struct("center", "first", "second")
        point = cut(rows.select(*KEY, "ord", "reply", pair.alias("pair1"), _none(_PAIR).alias("pair2"), _none(_EDGE).alias("edge"), "child", "child_paths"))
        made = c.select(*KEY, "ord", F.lit("point").alias("type"), F.col("node").alias("first"), F.lit(-1).alias("second"))
        held = made.join(point.where("child is not null").select(*KEY, "ord").distinct(), [*KEY, "ord"], "left_anti")
        vacuous = cut(held.groupBy(*KEY).agg(F.min("ord").alias("stop")))
        kept = lambda df: df.join(vacuous, KEY, "left").where("stop is null or ord <= stop").drop("stop")
        moves, replies = kept(made), kept(point)
    if o.end_moves:
        left = states if vacuous is None else states.join(vacuous, KEY, "left_anti")
        p = left.select(*KEY, "paths", F.explode("paths").alias("p"))
        end = p.select(*KEY, "paths", F.explode(F.array(F.struct(F.expr("p[0]").alias("endpoint"), F.expr("p[1]").alias("internal")), F.struct(F.expr("p[size(p)-1]").alias("endpoint"), F.expr("p[size(p)-2]").alias("internal")))).alias("e"))
        end = end.select(*KEY, "paths", "e.endpoint", "e.internal")
        given = ht.end_replies(graph, end)
        n = given.groupBy("g", "endpoint", "internal").agg(F.count("*").alias("n"))
        c = end.join(n, ["g", "endpoint", "internal"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
        c = c.withColumn("k", F.row_number().over(by.orderBy("n", "endpoint", "internal")) - 1)
        c = (c.where(F.col("k") < o.end) if o.end else c).where(allowed(F.col("n"))).withColumn("ord", F.col("k") + (1 << 20))
        rows = c.join(given, ["g", "endpoint", "internal"])
        rows = _children(rows, F.array(F.array("endpoint", "neighbor")), ["ord", "reply"])
        edge = F.struct(F.least("endpoint", "neighbor").alias("u"), F.greatest("endpoint", "neighbor").alias("v"))
        ends = cut(rows.select(*KEY, "ord", "reply", _none(_PAIR).alias("pair1"), _none(_PAIR).alias("pair2"), edge.alias("edge"), "child", "child_paths"))
        moves = moves.unionByName(c.select(*KEY, "ord", F.lit("end").alias("type"), F.col("endpoint").alias("first"), F.col("internal").alias("second")))
        replies = ends if replies is None else replies.unionByName(ends)
    if replies is None:
        replies = none.select(*KEY, F.lit(0).alias("ord"), F.lit(0).cast("bigint").alias("reply"), _none(_PAIR).alias("pair1"), _none(_PAIR).alias("pair2"), _none(_EDGE).alias("edge"), F.col("sid").alias("child"), F.col("paths").alias("child_paths"))
    return cut(moves), cut(replies)


def propagate(wave: Wave) -> DataFrame:
    """(KEY, proven, ord): truth of every state, and its first successful move (null for a leaf). A move without replies succeeds."""
    done, last = [], None
    for k in range(len(wave.states) - 1, -1, -1):
        s = wave.states[k].select(*KEY, F.coalesce("leaf.proven", F.lit(False)).alias("leaf"))
        if k < len(wave.moves):
            r = wave.replies[k].select(*KEY, "ord", "child")
            below = last if last is not None else s.limit(0).select(*KEY, F.lit(False).alias("proven"))
            truth = below.where("proven").select("g", "target", F.col("sid").alias("child"), F.lit(True).alias("t"))
            fails = r.join(truth, ["g", "target", "child"], "left").where("child is not null and t is null").select(*KEY, "ord").distinct()
            best = wave.moves[k].join(fails, [*KEY, "ord"], "left_anti").groupBy(*KEY).agg(F.min("ord").alias("ord"))
            s = s.join(best, KEY, "left")
        else:
            s = s.withColumn("ord", F.lit(None).cast("int"))
        last = cut(s.select(*KEY, (F.col("leaf") | F.col("ord").isNotNull()).alias("proven"), F.when(~F.col("leaf"), F.col("ord")).alias("ord")))
        done.append(last)
    return reduce(DataFrame.unionByName, done)


def outcomes(wave: Wave, truth: DataFrame) -> DataFrame:
    """(g, target, status, candidate, candidates, states, replies): proven with the first candidate that succeeds within the budgets, which count all candidates up to it; else unresolved."""
    o = wave.options
    one = lambda frames, name: reduce(DataFrame.unionByName, frames).groupBy("g", "target", F.expr("sid[0]").alias("rank")).agg(F.count("*").alias(name))
    states = one([s.select(*KEY) for s in wave.states[1:]] or [wave.states[0].limit(0).select(*KEY)], "states")
    replies = one([r.select(*KEY) for r in wave.replies], "replies")
    root = wave.states[0].select("g", "target", F.expr("sid[0]").alias("rank"), "sid").join(truth, KEY)
    rows = root.join(states, ["g", "target", "rank"], "left").join(replies, ["g", "target", "rank"], "left")
    upto = Window.partitionBy("g", "target").orderBy("rank")
    spent = lambda c: F.sum(F.coalesce(c, F.lit(0).cast("bigint"))).over(upto)
    rows = rows.withColumn("s", spent("states")).withColumn("r", spent("replies"))
    within = F.lit(True)
    if o.states:
        within = within & (F.col("s") <= o.states)
    if o.replies:
        within = within & (F.col("r") <= o.replies)
    rows = rows.withColumn("wins", F.col("proven") & within)
    got = rows.groupBy("g", "target").agg(F.min(F.when(F.col("wins"), F.col("rank"))).alias("candidate"), F.count("*").alias("candidates"), F.max("s").alias("states"), F.max("r").alias("replies"))
    got = wave.targets.select("g", "target").join(got, ["g", "target"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return got.select("g", "target", F.when(F.col("candidate").isNotNull(), "proven").otherwise("unresolved").alias("status"), "candidate", zero("candidates"), zero("states"), zero("replies"))


@dataclass
class Proof:
    """nodes(g, target, node, paths, type, first, second, leaf) and replies(g, target, node, reply, pair1, pair2, edge, infeasible, child), nodes in preorder from 0."""

    nodes: DataFrame
    replies: DataFrame


def extract(wave: Wave, truth: DataFrame, result: DataFrame) -> Proof:
    """The successful tree of each proven target: of each state its leaf proof, or its first successful move with all replies."""
    now = result.where("status = 'proven'").select("g", "target", F.array(F.col("candidate").cast("int")).alias("sid"), F.expr("cast(array() as array<int>)").alias("key"))
    nodes, replies = [], []
    for k, states in enumerate(wave.states):
        own = now.join(states, KEY).join(truth.select(*KEY, "ord"), KEY)
        if k < len(wave.moves):
            m = own.join(wave.moves[k], [*KEY, "ord"], "left")
        else:
            m = own.withColumns({"type": _none("string"), "first": _none("int"), "second": _none("int")})
        at = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
        m = cut(m.select(*KEY, "key", "ord", "paths", F.coalesce("type", F.lit("leaf")).alias("type"), at("first"), at("second"), F.when(F.col("ord").isNull(), F.col("leaf")).alias("leaf")))
        nodes.append(m.select("g", "target", "key", "paths", "type", "first", "second", "leaf"))
        if k >= len(wave.replies):
            break
        r = m.where("ord is not null").select(*KEY, "ord", "key").join(wave.replies[k], [*KEY, "ord"])
        r = r.withColumn("to", F.when(F.col("child").isNotNull(), F.concat("key", F.array(F.col("reply").cast("int")))))
        replies.append(r.select("g", "target", "key", "reply", "pair1", "pair2", "edge", "to"))
        now = r.where("to is not null").select("g", "target", F.col("child").alias("sid"), F.col("to").alias("key"))
    order = Window.partitionBy("g", "target").orderBy("key")
    all_ = cut(reduce(DataFrame.unionByName, nodes).withColumn("node", F.row_number().over(order) - 1))
    index = all_.select("g", "target", "key", "node")
    r = reduce(DataFrame.unionByName, replies).join(index, ["g", "target", "key"]).join(index.select("g", "target", F.col("key").alias("to"), F.col("node").alias("child")), ["g", "target", "to"], "left")
    return Proof(
        all_.select("g", "target", "node", "paths", "type", "first", "second", "leaf"),
        cut(r.select("g", "target", "node", "reply", "pair1", "pair2", "edge", F.col("to").isNull().alias("infeasible"), "child")),
    )


def prove(graph: Graph, targets: DataFrame, o: Options = Options()) -> tuple[DataFrame, Proof]:
    """Outcomes of all targets, and the proofs of the proven ones."""
    wave = search(graph, targets, o)
    truth = cut(propagate(wave))
    result = cut(outcomes(wave, truth))
    return result, extract(wave, truth, result)


def shallow(graph: Graph, targets: DataFrame, o: Options = Options()) -> tuple[DataFrame, Proof]:
    """The search without moves below the root: each joint reply of a candidate must be a leaf."""
    from dataclasses import replace

    return prove(graph, targets, replace(o, depth=0))
