"""Helpers over whole frames: how many rows, and ranges of values for work that is too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def few_rows(df: DataFrame, most: int) -> bool:
    """True if there are at most that many rows; looks at no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def edges(df: DataFrame, by: str, ranges: int, each: int = 64) -> list:
    """At most ranges - 1 values of the column, rising, that cut its distinct values into ranges of about equal size.

    They come from a sample of the values by their hash, some `each` for a range, which is all that
    the driver gets. Any type that has an order will do; nulls have no say.
    """
    values = df.select(F.col(by).alias("v")).where("v IS NOT NULL").distinct()
    step = max(1, values.count() // (ranges * each))
    some = [r["v"] for r in values.where(F.pmod(F.xxhash64("v"), F.lit(step)) == 0).orderBy("v").collect()]
    return sorted({some[len(some) * i // ranges] for i in range(1, ranges)}) if some else []


def range_of(value: Column, cuts: Column, n: Column) -> Column:
    """How many of the n rising cuts, an array, are at or below the value: by bisection, without Python. Null values are below all."""
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    steps = F.filter(steps, lambda s: s <= n)
    return F.aggregate(steps, F.lit(0), lambda r, s: F.when((r + s <= n) & (F.get(cuts, r + s - 1) <= value), r + s).otherwise(r))
