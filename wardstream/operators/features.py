"""Derived features: early-warning scores, haemodynamic ratios, slopes, unit flags."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.scalar import saturate


def mews(hr: Column, sbp: Column, rr: Column, temp: Column) -> Column:
    """Four terms in contiguous bands; a null scores 0 in its term."""
    h = F.when((hr < 40) | (hr > 130), 3).when((hr < 50) | (hr > 110), 2).when((hr < 60) | (hr > 100), 1).otherwise(0)
    s = F.when(sbp < 70, 3).when(sbp < 80, 2).when(sbp < 100, 1).otherwise(0)
    r = F.when((rr < 9) | (rr > 30), 3).when(rr > 25, 2).when((rr < 12) | (rr > 20), 1).otherwise(0)
    t = F.when((temp < 35) | (temp > 39), 2).when((temp < 36) | (temp > 38), 1).otherwise(0)
    return h + s + r + t


def news(rr: Column, spo2: Column, temp: Column, sbp: Column, hr: Column, gcs: Column) -> Column:
    """Six terms in bands between whole numbers: a value between two bands scores 0."""
    r = F.when((rr <= 8) | (rr >= 25), 3).when(rr.between(21, 24), 2).when(rr.between(9, 11), 1).otherwise(0)
    o = F.when(spo2 <= 91, 3).when(spo2 <= 93, 2).when(spo2 <= 95, 1).otherwise(0)
    t = F.when((temp <= 35) | (temp >= 39.1), 3).when(((temp > 35) & (temp <= 36)) | ((temp >= 38.1) & (temp < 39.1)), 1).otherwise(0)
    s = F.when((sbp <= 90) | (sbp >= 220), 3).when(sbp.between(91, 100), 2).when(sbp.between(101, 110), 1).otherwise(0)
    h = F.when((hr <= 40) | (hr >= 131), 3).when(hr.between(111, 130), 2).when(hr.between(41, 50) | hr.between(91, 110), 1).otherwise(0)
    return r + o + t + s + h + F.when(gcs < 15, 3).otherwise(0)


def shock_index(hr: Column, sbp: Column) -> Column:
    """hr / sbp between 0 and 3; null where sbp is 0 or either is missing (to be filled with the median)."""
    return F.try_divide(hr, F.when(sbp != 0, sbp))


def pulse_pressure(sbp: Column, dbp: Column) -> Column:
    return saturate(sbp - dbp, 0.0, 200.0)


def slope(y: str, t: str, key: str, rows: int = 6) -> Column:
    """Least-squares slope over the last rows; 0 with fewer than two points."""
    w = Window.partitionBy(key).orderBy(t).rowsBetween(-(rows - 1), 0)
    return F.coalesce(F.regr_slope(F.col(y), F.col(t)).over(w), F.lit(0.0))


#: Abbreviations of units.
UNITS = ("micu", "sicu", "ccu", "micu/sicu", "tsicu")


def unit_flags(unit: Column, names: tuple[str, ...] = UNITS) -> list[Column]:
    """1 where the unit's name holds the abbreviation in either case; one name may hold several."""
    return [F.coalesce(unit.rlike(f"(?i){u}"), F.lit(False)).cast("int").alias(f"icu_{u.replace('/', '_')}") for u in names]
