"""Array steps that take time in proportion to the array, from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def _sums(values: Column, first: Column) -> Column:
    """Running sums of a short array, from ``first`` on; each step copies what is there."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(values, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), first) + x)))


def running_sums(values: Column) -> Column:
    """Running sums of an array of bigint, block by block: first each block's total, then inside the blocks."""
    zero = F.lit(0).cast("bigint")

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x))
        return F.flatten(F.zip_with(blocks, _sums(totals, zero), lambda b, end: _sums(b, end - F.aggregate(b, zero, lambda acc, x: acc + x))))

    def cut(all_values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_values), F.lit(1)), F.lit(BLOCK))
        return F.transform(starts, lambda at: F.slice(all_values, at, F.lit(BLOCK)))

    return once(once(values, cut), of_blocks)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
