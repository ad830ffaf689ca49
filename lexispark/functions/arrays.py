"""Array expressions that stay inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one pass of a running sum goes over.
BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row: a lambda variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(values: Column) -> Column:
    """0 and the sums of the first 1, 2, ... values; each step copies what it has, so only for short arrays."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def running(values: Column) -> Column:
    """Sums of the first 1, 2, ..., n of n integers. Blocks are summed by themselves and then moved, so the work grows with n, not with its square."""

    def moved(blocks: Column) -> Column:
        bases = _sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, v: acc + v)))
        shift = lambda base: lambda s: F.transform(F.slice(s, F.lit(2), F.size(s)), lambda v: v + base)
        return bound(bases, lambda base: F.flatten(F.transform(blocks, lambda b, i: bound(_sums(b), shift(F.get(base, i))))))

    def cut(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))

    return bound(values, lambda v: bound(cut(v), moved))
