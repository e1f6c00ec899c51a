"""Integer distances as column expressions.

Squared distances stay exact in BIGINT. The fast form of a rounded root is one expression and exact below 2^48; the exact form corrects a
double root by one step either way, and repeats its argument, so it is for wide coordinates only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest squared distance for which rounding a double root is exact.
FAST_LIMIT = 1 << 48
#: Largest squared distance of the BIGINT path.
SAFE_LIMIT = (1 << 63) - 1

KINDS = ("EUC_2D", "CEIL_2D")


def squared(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return dx * dx + dy * dy


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: nested plain expressions would repeat it, and their code grow without bound."""
    return F.transform(F.array(value), body)[0]


def floor_root(s: Column) -> Column:
    """Largest r with r * r <= s."""
    root_of = lambda r, t: r - (r * r > t).cast("bigint") + ((r + 1) * (r + 1) <= t).cast("bigint")
    return _let(s, lambda t: _let(F.floor(F.sqrt(t.cast("double"))).cast("bigint"), lambda r: root_of(r, t)))


def rounded(s: Column, kind: str = "EUC_2D", fast: bool = True) -> Column:
    """Distance from a squared one: to the nearest integer (EUC_2D) or up (CEIL_2D)."""
    if fast:
        near = F.floor(F.sqrt(s.cast("double")) + 0.5) if kind == "EUC_2D" else F.ceil(F.sqrt(s.cast("double")))
        return near.cast("bigint")
    up = lambda r, t: r + ((t - r * r > r) if kind == "EUC_2D" else (r * r != t)).cast("bigint")
    return _let(s, lambda t: _let(floor_root(t), lambda r: up(r, t)))


def distance(ax: Column, ay: Column, bx: Column, by: Column, kind: str = "EUC_2D", fast: bool = True) -> Column:
    return rounded(squared(ax, ay, bx, by), kind, fast)


def floating(ax: Column, ay: Column, bx: Column, by: Column, kind: str = "EUC_2D") -> Column:
    """Distance of points that have no integer coordinates."""
    raw = F.hypot(ax - bx, ay - by)
    return (F.floor(raw + 0.5) if kind == "EUC_2D" else F.ceil(raw)).cast("bigint")


def is_integer(x: Column) -> Column:
    """Whether a coordinate is an integer that BIGINT and a double both hold."""
    return F.coalesce((x == F.floor(x)) & (F.abs(x) <= float(1 << 53)), F.lit(False))


def root(n: int) -> int:
    """Floor of a square root, by halving steps."""
    import math

    return math.isqrt(n)


def plain(ax: int, ay: int, bx: int, by: int, kind: str = "EUC_2D") -> int:
    """The same distance of two points in Python, for what runs inside an Arrow function."""
    s = (ax - bx) ** 2 + (ay - by) ** 2
    r = root(s)
    return r + (s - r * r > r if kind == "EUC_2D" else r * r != s)
