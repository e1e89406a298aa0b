"""Morton codes and signed-direction sets, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MORTON_BITS = 16


def morton(axes: list[Column], bits: int = MORTON_BITS) -> Column:
    """Interleaves the axes' bits; axis 0 has the lowest."""
    d = len(axes)
    terms = [F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), d * b + n) for n, c in enumerate(axes) for b in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), terms)


def morton_axis(z: Column, axis: int, d: int, bits: int = MORTON_BITS) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(z, d * b + axis).bitwiseAND(F.lit(1).cast("long")), b) for b in range(bits)])


def morton_set(z: Column, axis: int, value: Column, d: int, bits: int = MORTON_BITS) -> Column:
    """z with one axis replaced: its bits are cleared by a mask, and the value's put there."""
    mask = sum(1 << (d * b + axis) for b in range(bits))
    put = [F.shiftleft(F.shiftright(value.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), d * b + axis) for b in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), put, z.bitwiseAND(F.lit(~mask).cast("long")))


def direction_mask(s: Column) -> Column:
    """Bit p for +p, bit 31 + p for -p; |p| is 1 to 30."""
    return F.aggregate(s, F.lit(0).cast("long"), lambda a, p: a + F.pow(F.lit(2.0), F.when(p > 0, p).otherwise(31 - p)).cast("long"))


def negate(s: Column) -> Column:
    return F.array_sort(F.transform(s, lambda p: -p))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def direction_text(s: Column) -> Column:
    """`{1+2-}` for {+1, -2}."""
    by_axis = F.array_sort(s, lambda a, b: F.abs(a) - F.abs(b))
    return F.concat(F.lit("{"), F.array_join(F.transform(by_axis, lambda p: F.concat(F.abs(p).cast("string"), F.when(p > 0, "+").otherwise("-"))), ""), F.lit("}"))


def direction_parse(text: Column) -> Column:
    """The set that direction_text writes, ascending."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]+[+-])"), F.lit(1))
    value = lambda t: F.substring_index(F.substring_index(t, "+", 1), "-", 1).cast("int") * F.when(F.endswith(t, F.lit("-")), -1).otherwise(1)
    return F.array_sort(F.transform(parts, value))


def flip(s: Column, p: int) -> Column:
    """s with p put in if it lacks it, else taken out."""
    return F.array_sort(symmetric_difference(s, F.array(F.lit(p))))


def holds(s: Column, p: int) -> Column:
    return F.array_contains(s, p)


def is_superset(a: Column, b: Column) -> Column:
    return is_subset(b, a)
