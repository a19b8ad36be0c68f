"""Places of regular-expression matches as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running(numbers: Column) -> Column:
    """For each element the sum of those before it. Sums of blocks first, so a very long
    array costs n * 64 steps rather than n * n / 2."""
    blocks = F.when(F.size(numbers) > 0, F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _STEP).cast("int"))) \
        .otherwise(F.array().cast("array<int>"))
    sums = F.transform(blocks, lambda b: _sum(F.slice(numbers, b * _STEP + 1, F.lit(_STEP))))
    return let(sums, lambda s: let(
        F.transform(s, lambda _, j: _sum(F.slice(s, F.lit(1), j))),
        lambda before: F.transform(numbers, lambda _, i: F.get(before, F.floor(i / _STEP).cast("int"))
                                   + _sum(F.slice(numbers, (F.floor(i / _STEP) * _STEP + 1).cast("int"), i % _STEP)))))


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, stop, value>>`` of the leftmost non-overlapping non-empty
    matches, places in code points, ``stop`` exclusive; empty for a null text."""
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
        return let(gaps, lambda gap: let(
            F.transform(found, lambda m, i: F.get(gap, i) + F.char_length(m)),
            lambda both: let(running(both), lambda before: F.transform(
                found, lambda m, i: F.struct((F.get(before, i) + F.get(gap, i)).alias("start"),
                                             (F.get(before, i) + F.get(both, i)).alias("stop"), m.alias("value"))))))

    return F.when(text.isNull(), none).otherwise(let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found))))
