"""Column functions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    Within a lambda, an expression over columns is computed anew for every
    element; a lambda's variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums_before(values: Column, start: Column) -> Column:
    """``start`` plus the sum of the elements before each one; the array is copied once an element, so keep it short."""
    zero = F.struct(start.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))

    def step(state: Column, value: Column) -> Column:
        return F.struct((state["at"] + value).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    return F.aggregate(values, zero, step, lambda state: state["out"])


def sums_before(values: Column) -> Column:
    """The sum of the elements before each element of an array of long.

    Sums are made in blocks of 256 whose own starts are summed first, so an
    array of n elements costs about 128 n + (n / 256)² / 2 steps and not n² / 2.
    An empty array gives an empty one; elements must not be null.
    """

    def cut(all_: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(all_) - 1) / _BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_, b * _BLOCK + 1, F.lit(_BLOCK)))

    def add(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda s, v: s + v))
        return F.flatten(F.zip_with(blocks, _sums_before(totals, F.lit(0)), lambda block, start: _sums_before(block, start)))

    return let(let(values, cut), add)
