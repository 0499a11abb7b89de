"""Sliding windows over panes: rows are summed up by the pane that they fall into before anything is copied."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each kind of aggregate: what a pane keeps of the value, and how a window sums up what its panes have kept.
KINDS = {
    "count": (lambda x, by: F.count(x), F.sum),
    "sum": (lambda x, by: F.sum(x), F.sum),
    "min": (lambda x, by: F.min(x), F.min),
    "max": (lambda x, by: F.max(x), F.max),
    "avg": (lambda x, by: F.struct(F.sum(x).alias("s"), F.count(x).alias("n")), lambda p: F.try_divide(F.sum(p["s"]), F.sum(p["n"]))),
    "latest": (lambda x, by: F.max(F.when(by.isNotNull(), F.struct(by.alias("by"), x.alias("x")))), lambda p: F.max(p)["x"]),
    "median": (lambda x, by: F.collect_list(x), lambda p: middle(F.array_sort(F.flatten(F.collect_list(p))))),
}


def middle(xs: Column) -> Column:
    """The median of a sorted array; null if it is empty."""
    n = F.size(xs)
    at = lambda i: F.get(xs, F.floor(i).cast("int"))
    return F.when(n % 2 == 1, at(n / 2)).when(n > 0, (at(n / 2 - 1) + at(n / 2)) / 2)


def sliding(df: DataFrame, key: str, first: Column, last: Column, spec: Mapping[str, tuple], out: str = "obs") -> DataFrame:
    """One row per key and window with rows in it: key, out, and the aggregates of spec, name -> (how, value[, by]).

    A row belongs to the windows first..last, whole numbers; rows with no such window have none. how
    is count, sum, min, max, avg, median, or latest: the value of the row with the greatest `by`, ties
    to the greater value. Nulls have no say, a window without values gets null (count 0). A null key is a key.

    A pane holds the rows of a key that belong to the same windows. It is summed up on both sides of
    the first shuffle, panes are dealt by key, and only panes are copied, inside their task: what is
    shuffled is two rows for each key and pane, however many rows there are and however wide a window is. A
    median keeps its values, in the pane's row.
    """
    kept = {n: (KINDS[how], value, by[0] if by else F.lit(None)) for n, (how, value, *by) in spec.items()}
    rows = df.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    panes = rows.groupBy(key, "_first", "_last").agg(*[k[0](value, by).alias(n) for n, (k, value, by) in kept.items()])
    copied = panes.repartition(key).withColumn(out, F.explode(F.sequence("_first", "_last")))
    return copied.groupBy(key, out).agg(*[k[1](F.col(n)).alias(n) for n, (k, _, _) in kept.items()])


def hours(hour: str, width: int, first: int = 6, last: int = 72) -> tuple[Column, Column]:
    """The observation hours obs in first..last with obs - width < hour <= obs."""
    return F.greatest(F.col(hour), F.lit(first)), F.least(F.col(hour) + width - 1, F.lit(last))
