"""From raw measurements to hourly grids, sliding windows, censoring and labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hours_between


def first_per(df: DataFrame, key: str, *order: Column | str, where: Column | None = None) -> DataFrame:
    """The first row per key, of those that qualify."""
    rows = df if where is None else df.where(where)
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def onset(first_drug: Column, first_culture: Column, hours: float = 24) -> Column:
    """When infection is suspected: both within so many hours, the earlier; the drug alone, its time; else never."""
    near = F.abs(hours_between(first_drug, first_culture)) <= hours
    return F.when(first_drug.isNotNull() & first_culture.isNotNull() & near, F.least(first_drug, first_culture)).when(first_drug.isNotNull() & first_culture.isNull(), first_drug)


def shock(first_pressor: Column, first_lactate: Column, hours: float = 24) -> Column:
    """When both signs are there within so many hours: the later one's time."""
    return F.when(F.abs(hours_between(first_pressor, first_lactate)) <= hours, F.greatest(first_pressor, first_lactate))


def worst_ratio(num: Column, den: Column, other: float = 0.21) -> Column:
    """min(num / den) over all pairs of a group's positive values, without the pairs; a group without den divides by `other`."""
    return F.min(F.when(num > 0, num)) / F.coalesce(F.max(F.when(den > 0, den)), F.lit(other))


#: Organ scores as (operator, bound, score), the first that holds counts.
ORGAN_STEPS = {
    "resp": [("<", 100, 4), ("<", 200, 3), ("<", 300, 2), ("<", 400, 1)],
    "coag": [("<", 20, 4), ("<", 50, 3), ("<", 100, 2), ("<", 150, 1)],
    "liver": [(">=", 12, 4), (">=", 6, 3), (">=", 2, 2), (">=", 1.2, 1)],
    "cns": [("<", 6, 4), ("<", 10, 3), ("<", 13, 2), ("<", 15, 1)],
    "renal": [(">=", 5.0, 4), (">=", 3.5, 3), (">=", 2.0, 2), (">=", 1.2, 1)],
}


def cardio_score(dopamine: Column, epinephrine: Column, norepinephrine: Column, mean_bp: Column) -> Column:
    d, e, n = (F.coalesce(x, F.lit(0.0)) for x in (dopamine, epinephrine, norepinephrine))
    return F.when((d > 15) | (e > 0.1) | (n > 0.1), 4).when((d > 5) | (e > 0) | (n > 0), 3).when(d > 0, 2).when(mean_bp < 70, 1).otherwise(0)


def pivot(df: DataFrame, keys: list, spec: Mapping[str, tuple[str, Column, Column]], ts: str = "ts") -> DataFrame:
    """One pass over the rows: each output column aggregates the value where its condition holds.

    spec: name -> (median | min | max | sum | avg | count | latest, condition, value).
    """
    aggs = []
    for name, (how, cond, value) in spec.items():
        x = F.when(cond, value)
        if how == "latest":
            c = F.max_by(x, F.when(cond, F.col(ts)))
        elif how == "flag":
            c = F.max(F.when(cond, 1).otherwise(0))
        else:
            c = getattr(F, how)(x)
        aggs.append(c.alias(name))
    return df.groupBy(*keys).agg(*aggs)


def expand_hours(df: DataFrame, start: str, end: str, out: str = "hour") -> DataFrame:
    """A row for each full hour from start to end, both included; a null end counts as the start."""
    lo = F.date_trunc("hour", F.col(start))
    hi = F.greatest(lo, F.date_trunc("hour", F.coalesce(F.col(end), F.col(start))))
    return df.withColumn(out, F.explode(F.sequence(lo, hi, F.expr("interval 1 hour")))).withColumn(out, F.col(out).cast("timestamp_ntz"))


def into_windows(df: DataFrame, hour: str, width: int, first: int = 6, last: int = 72, out: str = "obs") -> DataFrame:
    """Each row once for every observation hour obs in first..last with obs - width < hour <= obs: a fan-out of at most width, no range join."""
    lo, hi = F.greatest(F.col(hour), F.lit(first)), F.least(F.col(hour) + width - 1, F.lit(last))
    return df.where(lo <= hi).withColumn(out, F.explode(F.sequence(lo, hi)))


def observation_grid(stays: DataFrame, start: str, end: str, first: int = 6, last: int = 72, out: str = "obs") -> DataFrame:
    """Each stay's observation hours first..last, as far as it lasts."""
    grid = stays.withColumn(out, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.withColumn("window_end", (F.col(start) + F.make_dt_interval(hours=F.col(out))).cast("timestamp_ntz")).where(F.col("window_end") <= F.col(end))


def censored(windows: DataFrame, end: str, events: list[str]) -> DataFrame:
    """Windows that end before every event that happens at all."""
    keep = F.lit(True)
    for e in events:
        keep = keep & (F.col(e).isNull() | (F.col(end) < F.col(e)))
    return windows.where(keep)


def labels(end: str, events: Mapping[str, str], horizons: tuple[int, ...] = (6, 12, 24)) -> list[Column]:
    """event in (end, end + H] as 0/1 for each event and horizon, and whether any of them is."""
    out = []
    for h in horizons:
        hits = []
        for name, col in events.items():
            gap = hours_between(F.col(col), F.col(end))
            hit = F.when((gap > 0) & (gap <= h), 1).otherwise(0)
            hits.append(hit)
            out.append(hit.alias(f"{name}_next_{h}h"))
        out.append(F.greatest(*hits).alias(f"composite_next_{h}h") if len(hits) > 1 else hits[0].alias(f"composite_next_{h}h"))
    return out
