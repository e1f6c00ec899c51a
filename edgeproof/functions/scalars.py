"""Small scalar functions: text, codes, checked arithmetic, closed-form counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("jv", "hamilton-tutte")


def hex16(x: Column) -> Column:
    """A 64-bit number as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def hex_encode(text: Column) -> Column:
    return F.lower(F.hex(F.encode(text, "UTF-8")))


def hex_decode(text: Column) -> Column:
    """Text of hexadecimal digits; null where they are none, or an odd number of them."""
    sound = text.rlike("^([0-9a-fA-F]{2})*$")
    return F.when(sound, F.decode(F.unhex(F.when(sound, text)), "UTF-8"))


def checked_product(a: Column, b: Column) -> Column:
    """a * b, null beyond BIGINT."""
    return F.try_multiply(a, b)


def checked_sum(a: Column, b: Column) -> Column:
    """a + b, null beyond BIGINT."""
    return F.try_add(a, b)


def conservative_integer(x: Column) -> Column:
    """The integer that a double stands for: within 1e-9 of it and of at most 1e12; else null."""
    r = F.round(x)
    return F.when((F.abs(x) <= 1e12) & (F.abs(x - r) <= 1e-9), r.cast("bigint"))


def strict_integer(text: Column) -> Column:
    """An integer token without sign +, blanks or trailing text; else null."""
    return F.when(text.rlike("^-?[0-9]+$"), F.try_to_number(F.when(text.rlike("^-?[0-9]{1,18}$"), text), F.lit("S999999999999999999")).cast("bigint"))


def strict_hash(text: Column) -> Column:
    """A token of 16 lower-case hexadecimal digits; else null."""
    return F.when(text.rlike("^[0-9a-f]{16}$"), text)


def single_line(text: Column) -> Column:
    """Trimmed, with line breaks and tabs as blanks."""
    return F.trim(F.translate(text, "\r\n\t", "   "))


def log2_bucket(n: Column) -> Column:
    """Floor of the binary logarithm; 0 up to 1."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n)) - 1).cast("int")


def outside_count(paths: Column) -> Column:
    """Ways to join the ends of so many paths outside them into one tour: 2^(m-1) * (m-1)!."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(paths - 1, F.lit(1))), F.lit(1).cast("bigint"), lambda a, k: F.when(paths > 1, a * 2 * k).otherwise(a))


def inside_count(paths: Column) -> Column:
    """Perfect matchings of the ends of so many paths: (2m-1)!!."""
    return F.aggregate(F.sequence(F.lit(1), paths), F.lit(1).cast("bigint"), lambda a, k: a * (2 * k - 1))


def midpoint_score(x: Column, y: Column, ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Squared distance to the midpoint of u and v, times four."""
    dx, dy = 2 * x - ux - vx, 2 * y - uy - vy
    return dx * dx + dy * dy


def survives_two_opt(t: Column, o: Column, uo: Column, vp: Column, up: Column, vo: Column) -> Column:
    """Whether one of the two exchanges of target uv (cost t) and edge op (cost o) does not shorten: uo + vp, or up + vo."""
    return (uo + vp >= t + o) | (up + vo >= t + o)
