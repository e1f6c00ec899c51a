"""Hamilton-Tutte search that stops: depth first in what it expands, over all targets at once.

Each round takes, of every target still open, its next root candidate; of every open state the first move not yet tried; and of a move its
first few replies before the rest; of the states that a move leaves open, the first before its siblings. A failed reply ends its move, a successful move ends its state, a proven candidate ends its target: what
is settled leaves by anti-joins, and what hangs on it is never made. Rows are those of ``wavefront``, so truth, outcomes and proofs come
from there, and are the same as of the whole search.

Budgets bound what is made. Before replies are made, a target's are counted and added to what it has used; where that would pass a budget
(of replies, or of the states that they lead to), the target is exhausted: nothing more is made for it, and it stays unresolved.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeproof.plans.cut import cut

from . import wavefront
from .graph import Graph
from .wavefront import KEY, Options, Proof, Wave

#: Replies of a root candidate whose states are judged before the others.
FIRST = 8
_TARGET = ["g", "target"]


def within(needs: DataFrame, used: DataFrame, states: int, replies: int) -> tuple[DataFrame, DataFrame]:
    """(g, target, states, replies) used after ``needs`` (the same columns) of those targets that stay within both budgets (0: none), and the targets that would not."""
    both = needs.join(used.select(*_TARGET, F.col("states").alias("s"), F.col("replies").alias("r")), _TARGET, "left")
    total = both.select(*_TARGET, (F.col("states") + F.coalesce("s", F.lit(0))).alias("states"), (F.col("replies") + F.coalesce("r", F.lit(0))).alias("replies"))
    fits = F.lit(True)
    if states:
        fits = fits & (F.col("states") <= states)
    if replies:
        fits = fits & (F.col("replies") <= replies)
    return total.where(fits), total.where(~fits).select(*_TARGET)


def held(rows: DataFrame) -> DataFrame:
    """``rows`` cut, in no more parts than a shuffle makes: unions add up."""
    return cut(rows.coalesce(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


@dataclass
class _Run:
    graph: Graph
    targets: DataFrame
    o: Options
    near: DataFrame | None
    used: DataFrame
    exhausted: DataFrame
    states: list[list[DataFrame]] = field(default_factory=list)
    moves: list[list[DataFrame]] = field(default_factory=list)
    replies: list[list[DataFrame]] = field(default_factory=list)

    def keep(self, kind: str, level: int, rows: DataFrame) -> None:
        frames = getattr(self, kind)
        while len(frames) <= level:
            frames.append([])
        frames[level].append(rows)

    def reserve(self, rows: DataFrame) -> DataFrame:
        """The replies of targets that can afford them all; the other targets are exhausted."""
        if not self.o.states and not self.o.replies:
            return rows
        needs = cut(rows.groupBy(*_TARGET).agg(F.count("child").alias("states"), F.count("*").alias("replies")))
        total, over = within(needs, self.used, self.o.states, self.o.replies)
        self.used = held(total.unionByName(self.used.join(total, _TARGET, "left_anti")))
        over = cut(over)
        if over.isEmpty():
            return rows
        self.exhausted = held(self.exhausted.unionByName(over).distinct())
        return cut(rows.join(over, _TARGET, "left_anti"))

    def alive(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.exhausted, _TARGET, "left_anti")

    def prove(self, states: DataFrame, depth: int) -> DataFrame:
        """KEY of the ``states`` (KEY, paths) that are proven: by a leaf, or by the first of their moves all of whose replies are."""
        done = cut(wavefront.with_leaves(self.graph, states, self.targets, self.o.leaf).select(*KEY, F.lit(depth).alias("depth"), "paths", "leaf"))
        self.keep("states", depth + 1, done)
        good = done.where("leaf.proven").select(*KEY)
        if depth >= self.o.depth:
            return good
        # the siblings of a state are the other replies to its move: where one fails, the others need no proof
        move = F.expr("slice(sid, 1, size(sid) - 1)")
        turn = F.row_number().over(Window.partitionBy(*_TARGET, "move").orderBy("sid"))
        pending = cut(done.where("not leaf.proven").select(*KEY, "paths").withColumn("move", move).withColumn("turn", turn))
        first = pending.where("turn = 1")
        if first.isEmpty():
            return good
        one = self.by_moves(first.select(*KEY, "paths"), depth)
        lost = first.join(one, KEY, "left_anti").select(*_TARGET, "move")
        rest = held(pending.where("turn > 1").join(lost, [*_TARGET, "move"], "left_anti").select(*KEY, "paths"))
        good = good.unionByName(one)
        return held(good if rest.isEmpty() else good.unionByName(self.by_moves(rest, depth)))

    def by_moves(self, pending: DataFrame, depth: int) -> DataFrame:
        """KEY of the states (KEY, paths) one of whose moves succeeds; a state's moves are tried in order."""
        good = pending.limit(0).select(*KEY)
        moves, replies = wavefront.expansion(self.graph, self.targets, self.o, pending, self.near)
        moves = cut(moves.withColumn("turn", F.row_number().over(Window.partitionBy(*KEY).orderBy("ord"))))
        pending = pending.select(*KEY)
        for turn in range(1, (moves.agg(F.max("turn")).first()[0] or 0) + 1):
            now = cut(self.alive(moves.where(F.col("turn") == turn).drop("turn").join(pending, KEY, "left_semi")))
            if now.isEmpty():
                break
            rows = self.reserve(cut(replies.join(now.select(*KEY, "ord"), [*KEY, "ord"], "left_semi")))
            now = self.alive(now)
            self.keep("moves", depth + 1, now)
            self.keep("replies", depth + 1, rows.drop("child_paths"))
            won = cut(now.select(*KEY).join(self.failed(rows, depth + 1), KEY, "left_anti"))
            good, pending = held(good.unionByName(won)), held(pending.join(won, KEY, "left_anti"))
        return good

    def failed(self, rows: DataFrame, depth: int) -> DataFrame:
        """KEY of the states some of whose replies ``rows`` lead to a state that is not proven."""
        child = rows.where("child is not null")
        if child.isEmpty():
            return rows.limit(0).select(*KEY)
        good = self.prove(child.select(*_TARGET, F.col("child").alias("sid"), F.col("child_paths").alias("paths")), depth)
        return cut(child.join(good.withColumnRenamed("sid", "child"), [*_TARGET, "child"], "left_anti").select(*KEY).distinct())


def search(graph: Graph, targets: DataFrame, o: Options = Options(), first: int = FIRST) -> tuple[Wave, DataFrame]:
    """What was made until each target was proven, exhausted or out of candidates; and the exhausted targets (g, target)."""
    nothing = targets.select(*_TARGET).limit(0)
    run = _Run(graph, targets, o, wavefront.point_order(graph, targets, o), cut(nothing.withColumns({"states": F.lit(0).cast("bigint"), "replies": F.lit(0).cast("bigint")})), cut(nothing))
    roots, moves, replies = wavefront.root_moves(graph, targets, o)
    roots, moves = cut(roots), cut(moves)
    left = cut(targets.select(*_TARGET))
    rank = F.expr("sid[0]")
    for k in [r[0] for r in roots.select(rank.alias("rank")).distinct().orderBy("rank").collect()]:
        now = cut(run.alive(roots.where(rank == k).join(left, _TARGET, "left_semi")))
        if now.isEmpty():
            continue
        rows = run.reserve(cut(replies.join(now.select(*KEY), KEY, "left_semi")))
        now = cut(run.alive(now))
        run.keep("states", 0, now)
        run.keep("moves", 0, moves.join(now.select(*KEY), KEY, "left_semi"))
        open_ = now.select(*KEY)
        for part in (rows.where(F.col("reply") < first), rows.where(F.col("reply") >= first)):
            part = cut(part.join(open_, KEY, "left_semi"))
            run.keep("replies", 0, part.drop("child_paths"))
            open_ = cut(run.alive(open_.join(run.failed(part, 0), KEY, "left_anti")))
            if open_.isEmpty():
                break
        left = held(left.join(open_, _TARGET, "left_anti"))
    wave = Wave(graph, targets, o)
    empty = {"states": roots, "moves": moves, "replies": replies.drop("child_paths")}
    for kind, rows in empty.items():
        frames = getattr(run, kind)
        setattr(wave, kind, [held(reduce(DataFrame.unionByName, f)) for f in frames if f] or [rows.limit(0)])
    return wave, run.exhausted


def prove(graph: Graph, targets: DataFrame, o: Options = Options(), first: int = FIRST) -> tuple[DataFrame, Proof]:
    """Outcomes of all targets as of ``wavefront.prove``, with exhausted; and the proofs of the proven ones. states and replies count what was made."""
    wave, exhausted = search(graph, targets, o, first)
    truth = cut(wavefront.propagate(wave))
    result = wavefront.outcomes(wave, truth).join(exhausted.withColumn("exhausted", F.lit(True)), _TARGET, "left")
    result = cut(result.withColumn("exhausted", F.coalesce("exhausted", F.lit(False))))
    return result, wavefront.extract(wave, truth, result)
