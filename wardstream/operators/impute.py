"""Filling gaps: within the patient by default, or across patients as the reference's flat back-fill does."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.frames import edges, range_of
from ..sources.stages import stage
from .quantiles import medians
from .segments import FITS, windows


def ffill(c: str, key: str, order: str, limit: int | None = None) -> Column:
    """The last value at or before the row, at most `limit` rows back."""
    return F.last(c, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def bfill(c: str, key: str, order: str) -> Column:
    return F.first(c, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing))


def fill_both(df: DataFrame, cols: list[str], key: str, order: str, mode: str = "strict_patient", fits: int = FITS) -> DataFrame:
    """Forward and then backward. strict_patient: never across keys.

    reference: the back-fill runs over the flat table, ordered by key (null last) and order, so a key
    without any value takes the next key's first. That needs no sort of the whole table: what a key
    lends to the ones before it is its first value, one row per key. Keys of any type that has an
    order will do; rows of a null key are a key of their own and stay.
    """
    if mode not in ("strict_patient", "reference"):
        raise ValueError(mode)
    df = filled(df, {c: None for c in cols}, key, order, fits)
    return borrowed(df, cols, key, order) if mode == "reference" else df


def filled(df: DataFrame, limits: Mapping[str, int | None], key: str, order: str, fits: int = FITS) -> DataFrame:
    """Each column filled forward by at most so many rows, or without a limit forward and then backward, all over one sort by key."""
    spec = {f"_f_{c}": ("last", c) if k is None else ("last", c, k) for c, k in limits.items()} | {f"_b_{c}": ("next", c) for c, k in limits.items() if k is None}
    out = windows(df, key, [order], spec, fits)
    return out.select(*[(F.coalesce(f"_f_{c}", f"_b_{c}") if limits[c] is None else F.col(f"_f_{c}")).alias(c) if c in limits else F.col(c) for c in df.columns])


def borrowed(df: DataFrame, cols: list[str], key: str, order: str) -> DataFrame:
    """df, filled by key, with what is still missing taken from the next key that has a value."""
    out = df.join(lent(df, cols, key, order), F.col(key).eqNullSafe(F.col("_key")))
    return out.select(*[F.coalesce(c, f"_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def lent(df: DataFrame, cols: list[str], key: str, order: str, ranges: int = 64) -> DataFrame:
    """(_key, _col for each col): the first value of the nearest key after this one that has any, from rows filled by key.

    One row per key is sorted, in two levels: ranges of keys, each in a task of its own, and one row
    per range that says what the ranges after it lend. A null key comes after all, in the last range.
    """
    first = stage(df.groupBy(F.col(key).alias("_key")).agg(*[F.min_by(c, order).alias(f"_{c}") for c in cols]))
    cuts = edges(first, "_key", ranges)
    named = F.array(*[F.lit(x) for x in cuts]).cast(ArrayType(first.schema["_key"].dataType))
    placed = first.withColumn("_range", F.when(F.col("_key").isNull(), ranges).otherwise(range_of(F.col("_key"), named, F.lit(len(cuts)))))
    nulls_last = F.struct(F.col("_key").isNull(), F.col("_key"))
    inside = Window.partitionBy("_range").orderBy(nulls_last).rowsBetween(1, Window.unboundedFollowing)
    beyond = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)  # at most `ranges` rows and one
    of_range = placed.groupBy("_range").agg(*[F.min_by(f"_{c}", F.when(F.col(f"_{c}").isNotNull(), nulls_last)).alias(f"_{c}_r") for c in cols])
    of_range = of_range.select("_range", *[F.first(f"_{c}_r", ignorenulls=True).over(beyond).alias(f"_{c}_r") for c in cols])
    out = placed.withColumns({f"_{c}": F.first(f"_{c}", ignorenulls=True).over(inside) for c in cols}).join(F.broadcast(of_range), "_range")
    return out.select("_key", *[F.coalesce(f"_{c}", f"_{c}_r").alias(f"_{c}") for c in cols])


def with_median(df: DataFrame, cols: list[str], key: str | None = None, fits: int = FITS) -> DataFrame:
    """Nulls become the column's exact median, over the key's rows or over all; what has none stays null."""
    m = medians(df, cols, key, fits)
    if key:
        m = m.withColumnRenamed(key, "_key")
        out = df.join(m, F.col(key).eqNullSafe(F.col("_key")), "left")
    else:
        out = df.crossJoin(F.broadcast(m))  # one row
    return out.select(*[F.coalesce(c, f"_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class Step:
    """How some columns are filled: within `limit` rows (None: forward and backward without limit), then a patient's median, then a constant or the median of all."""

    cols: tuple[str, ...]
    limit: int | None
    constant: float | None = None


#: The order of the steps and their constants.
STEPS = (
    Step(("hr", "rr", "spo2", "sbp", "dbp", "mbp"), None), Step(("temp",), 6, 36.8), Step(("creatinine", "wbc", "platelets"), 24), Step(("potassium", "sodium"), 12),
    Step(("lactate",), 12, 1.2), Step(("ph",), 12, 7.40), Step(("bilirubin",), 24), Step(("gcs_total",), None), Step(("urine_ml_6h",), None),
)
#: Clinical ranges; values outside become null.
RANGES = {
    "hr": (20, 250), "rr": (4, 60), "spo2": (40, 100), "sbp": (30, 300), "dbp": (10, 200), "mbp": (20, 200), "temp": (30, 43), "creatinine": (0.1, 25), "wbc": (0.1, 150), "platelets": (1, 1500),
    "potassium": (1.5, 10), "sodium": (100, 180), "lactate": (0.1, 30), "ph": (6.5, 8.0), "bilirubin": (0.1, 60), "gcs_total": (3, 15), "urine_ml_6h": (0, 10000),
}


def impute(df: DataFrame, key: str, order: str, version: int = 1, mode: str = "strict_patient", steps: tuple[Step, ...] = STEPS, ranges: dict = RANGES) -> DataFrame:
    """Missing flags, ranges (version 1), fills in order; version 2 puts the patient's median between fill and constant.

    Flags of lactate are taken after the ranges, as of what is missing then. No column's fill depends
    on another's, so all of them are filled over one sort by key, and all medians, of patients or of
    the whole, come from one aggregation each. Null and text keys are keys like others.
    """
    have = set(df.columns)
    if "sao2" in have:
        df = df.withColumn("abga_checked", F.col("sao2").isNotNull().cast("int")).drop("sao2")
    if "bilirubin" in have:
        df = df.withColumn("bilirubin_missing", F.col("bilirubin").isNull().cast("int"))
    if version == 1:
        df = df.withColumns({c: F.when(F.col(c).between(*r), F.col(c)) for c, r in ranges.items() if c in have})
    if "lactate" in have:
        df = df.withColumn("lactate_missing", F.col("lactate").isNull().cast("int"))
    if version == 2 and "ph" in have:
        df = df.withColumn("ph_missing", F.col("ph").isNull().cast("int"))
    steps = tuple(Step(tuple(c for c in s.cols if c in have), s.limit, s.constant) for s in steps)
    both = [c for s in steps if s.limit is None for c in s.cols]
    limited = {c: s.limit for s in steps if s.limit is not None for c in s.cols}
    fixed = {c: s.constant for s in steps if s.constant is not None for c in s.cols}
    if mode not in ("strict_patient", "reference"):
        raise ValueError(mode)
    df = filled(df, dict.fromkeys(both) | limited, key, order)
    if mode == "reference" and both:
        df = borrowed(df, both, key, order)
    if version == 2 and limited:
        df = with_median(df, list(limited), key)
    df = df.fillna(fixed) if fixed else df
    rest = [c for c in (*both, *limited) if c not in fixed]
    df = with_median(df, rest) if rest else df
    return df.fillna(0, ["oliguria_flag"]) if "oliguria_flag" in have else df
