"""Catalogs of endpoint matchings: outside, inside, compatibility, reconnection templates.

Path i of m has the ends 2i and 2i + 1; a matching is an array of mates, and follows from its number, as order is part of a catalog's meaning: the
tables below are made by expressions over ids (m <= 7), the tuples serve hashes and the inside of leaves.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from itertools import permutations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeproof.functions import fnv
from edgeproof.functions.scalars import inside_count, outside_count
from edgeproof.plans.order import numbered

MOST_PATHS = 7
#: Most paths with a whole compatibility table.
TABLE_PATHS = 5

Mates = tuple[int, ...]


def _check(m: int, most: int = MOST_PATHS) -> None:
    if not 1 <= m <= most:
        raise ValueError(f"path count must be from 1 to {most}")


def _mates(pairs: list[tuple[int, int]]) -> Mates:
    out = [0] * (2 * len(pairs))
    for a, b in pairs:
        out[a], out[b] = b, a
    return tuple(out)


@lru_cache(maxsize=None)
def outside(m: int) -> tuple[Mates, ...]:
    """Ways to join m paths outside them into one tour: path 0 forward, the others in every order and direction; orders lexicographic, directions as a number whose lowest bit is the first path's."""
    _check(m)
    out = []
    for order in permutations(range(1, m)):
        for bits in product((0, 1), repeat=m - 1):
            turned = bits[::-1]  # product varies its last place fastest
            chain = [0, 1] + [2 * p + (t ^ end) for p, t in zip(order, turned, strict=True) for end in (0, 1)]
            out.append(_mates([(chain[k], chain[(k + 1) % (2 * m)]) for k in range(1, 2 * m, 2)]))
    return tuple(out)


@lru_cache(maxsize=None)
def inside(m: int) -> tuple[Mates, ...]:
    """Perfect matchings of 2m ends: the lowest free end with each higher one in turn."""
    _check(m)

    def matched(free: tuple[int, ...]) -> list[list[tuple[int, int]]]:
        if not free:
            return [[]]
        return [[(free[0], b), *rest] for i, b in enumerate(free) if i for rest in matched(free[1:i] + free[i + 1 :])]

    return tuple(_mates(p) for p in matched(tuple(range(2 * m))))


def one_tour(first: Mates, second: Mates) -> bool:
    """Whether two perfect matchings alternate along a single cycle."""
    at, steps = 0, 0
    while True:
        at = second[first[at]]
        steps += 2
        if at == 0:
            return steps == len(first)


@lru_cache(maxsize=None)
def compatible(m: int) -> tuple[frozenset[int], ...]:
    """Of each inside matching the outside ones with which it closes one tour."""
    _check(m, TABLE_PATHS)
    return tuple(frozenset(o for o, x in enumerate(outside(m)) if one_tour(x, y)) for y in inside(m))


@lru_cache(maxsize=None)
def table_hash(m: int) -> str:
    n, words = len(outside(m)), -(-len(outside(m)) // 64)
    rows = (sum(1 << o for o in row) for row in compatible(m))
    return fnv.compatibility_hash(m, n, len(inside(m)), words, [bits >> 64 * w & (1 << 64) - 1 for bits in rows for w in range(words)])


@lru_cache(maxsize=None)
def templates(k: int) -> tuple[Mates, ...]:
    """Proper reconnections of a tour without k edges: ports 2i, 2i + 1 are tail and head of the i-th, no edge comes back, one tour results."""
    if k not in (3, 4, 5):
        raise ValueError("k must be 3, 4 or 5")
    parts = _mates([(2 * i + 1, (2 * i + 2) % (2 * k)) for i in range(k)])
    return tuple(x for x in inside(k) if one_tour(parts, x) and all(x[2 * i] != 2 * i + 1 for i in range(k)))


def templates_hash(k: int) -> str:
    return fnv.templates_hash(k, [list(t) for t in templates(k)])


# ---- the same as tables ----


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _mated(ends: Column) -> Column:
    """The array of mates of ends that stand in pairs one after the other."""
    mate = lambda x, e: F.element_at(x, ((F.array_position(x, e) - 1).bitwiseXOR(F.lit(1).cast("bigint")) + 1).cast("int"))
    return _bound(ends, lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda e: mate(x, e)))


def _upto(n: Column) -> Column:
    """0 .. n - 1; an empty array for n = 0."""
    return F.slice(F.sequence(F.lit(0), n), 1, n)


def outside_at(m: Column, number: Column) -> Column:
    """The outside matching of a number, without its catalog: the number's low m - 1 bits are the directions, the rest in factorial base picks the
    paths one by one from those left. Null where there is no such number."""
    turns = m - 1
    start = F.struct(F.transform(_upto(turns), lambda k: k + 1).alias("free"), F.array().cast("array<int>").alias("order"), F.floor(number / F.pow(F.lit(2.0), turns)).cast("bigint").alias("rest"))

    def pick(s: Column, k: Column) -> Column:
        w = F.factorial(turns - 1 - k)
        i = F.floor(s["rest"] / w).cast("int")
        return F.struct(F.concat(F.slice(s["free"], 1, i), F.slice(s["free"], i + 2, F.size(s["free"]))).alias("free"), F.array_append(s["order"], F.element_at(s["free"], i + 1)).alias("order"), (s["rest"] % w).alias("rest"))

    order = F.aggregate(_upto(turns), start, pick)["order"]
    turned = lambda k: F.floor(number / F.pow(F.lit(2.0), k)).cast("int") % 2
    ends = F.flatten(F.transform(order, lambda p, k: F.array(2 * p + turned(k), 2 * p + 1 - turned(k))))
    return F.when((m >= 1) & (m <= MOST_PATHS) & (number >= 0) & (number < outside_count(m)), _mated(F.concat(F.array(F.lit(1)), ends, F.array(F.lit(0)))))


def inside_at(m: Column, number: Column) -> Column:
    """The inside matching of a number, without its catalog: the lowest free end takes the place among the others that the number's next digit
    tells, in a base that falls by two. Null where there is no such number."""
    odd = F.array(*(F.lit(math.prod(range(1, 2 * j, 2))).cast("bigint") for j in range(MOST_PATHS)))
    start = F.struct(_upto(2 * m).alias("free"), F.array().cast("array<int>").alias("ends"), number.cast("bigint").alias("rest"))

    def pick(s: Column, k: Column) -> Column:
        w = F.element_at(odd, m - k)
        i = F.floor(s["rest"] / w).cast("int")
        left = F.concat(F.slice(s["free"], 2, i), F.slice(s["free"], i + 3, F.size(s["free"])))
        return F.struct(left.alias("free"), F.concat(s["ends"], F.array(F.element_at(s["free"], 1), F.element_at(s["free"], i + 2))).alias("ends"), (s["rest"] % w).alias("rest"))

    ends = F.aggregate(_upto(m), start, pick)["ends"]
    return F.when((m >= 1) & (m <= MOST_PATHS) & (number >= 0) & (number < inside_count(m)), _mated(ends))


def matchings(spark: SparkSession, which: str, most: int = TABLE_PATHS, least: int = 1) -> DataFrame:
    """(m, matching_id, mates) of all catalogs from ``least`` to ``most`` paths; every matching is made from its number, where it is needed."""
    at = {"outside": outside_at, "inside": inside_at}[which]
    sizes = {m: math.factorial(m - 1) << (m - 1) if which == "outside" else math.prod(range(1, 2 * m, 2)) for m in range(least, most + 1)}
    first = {m: sum(sizes[k] for k in range(least, m)) for m in sizes}
    m = F.coalesce(*(F.when(F.col("id") >= first[k], F.lit(k)) for k in reversed(sizes)))
    numbers = spark.range(sum(sizes.values())).select(m.alias("m"), (F.col("id") - F.coalesce(*(F.when(F.col("id") >= first[k], F.lit(first[k])) for k in reversed(sizes)))).alias("matching_id"))
    return numbers.select("m", "matching_id", at(F.col("m"), F.col("matching_id")).alias("mates"))


def templates_table(spark: SparkSession) -> DataFrame:
    """(k, template_id, mates): the inside matchings that bring no deleted edge back and close one tour with the parts; ids in their order."""
    k = F.col("m")
    parts = F.transform(_upto(2 * k), lambda e: F.when(e % 2 == 1, (e + 1) % (2 * k)).otherwise((e + 2 * k - 1) % (2 * k)))
    new = F.forall(_upto(k), lambda i: F.element_at("mates", 2 * i + 1) != 2 * i + 1)
    good = matchings(spark, "inside", 5, 3).where(new & alternates(parts, F.col("mates")))
    return numbered(good, ["matching_id"], "template_id", "m").select(k.alias("k"), "template_id", "mates")


def is_perfect(mates: Column, m: Column) -> Column:
    """Whether an array of mates is a perfect matching of 2m ends."""
    ends = F.sequence(F.lit(0), F.size(mates) - 1)
    sound = F.forall(ends, lambda e: (F.element_at(mates, e + 1) >= 0) & (F.element_at(mates, e + 1) < F.size(mates)) & (F.element_at(mates, e + 1) != e))
    mutual = F.forall(ends, lambda e: F.element_at(mates, F.element_at(mates, e + 1) + 1) == e)
    return F.when((F.size(mates) != 2 * m) | (m < 1) | (m > MOST_PATHS), F.lit(False)).otherwise(F.when(sound, mutual).otherwise(F.lit(False)))


def alternates(first: Column, second: Column) -> Column:
    """Whether two perfect matchings of the same ends make one cycle: walking both from end 0 is back there after all of them, and not before."""
    half = F.size(first) / 2
    step = lambda a: F.element_at(second, F.element_at(first, a + 1) + 1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("back"))
    walk = F.aggregate(F.sequence(F.lit(1), half.cast("int")), start, lambda s, i: F.struct(step(s["at"]).alias("at"), F.when((s["back"] == 0) & (step(s["at"]) == 0), i).otherwise(s["back"]).alias("back")))
    return walk["back"] == half


def compatibility(spark: SparkSession, most: int = 4) -> DataFrame:
    """(m, outside_id, inside_id, compatible): every pair of the two catalogs, by the walk in SQL; tables are small by proof and joined on m."""
    o = matchings(spark, "outside", most).withColumnsRenamed({"matching_id": "outside_id", "mates": "o"})
    i = matchings(spark, "inside", most).withColumnsRenamed({"matching_id": "inside_id", "mates": "i"})
    return o.join(i, "m").select("m", "outside_id", "inside_id", alternates(F.col("o"), F.col("i")).alias("compatible"))


def evaluate(spark: SparkSession, queries: DataFrame) -> DataFrame:
    """``queries`` (m, outside_id, inside_id) with compatible, by the walk over both matchings, which each row makes from its numbers: no table, no
    join; null for ids that do not exist."""
    m = F.col("m").cast("int")
    walk = F.transform(F.array(F.struct(outside_at(m, F.col("outside_id")).alias("o"), inside_at(m, F.col("inside_id")).alias("i"))), lambda s: F.when(s["o"].isNotNull() & s["i"].isNotNull(), alternates(s["o"], s["i"])))
    return queries.withColumn("compatible", walk[0])

