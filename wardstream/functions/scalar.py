"""Null-aware scalar expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A double, or null where the text is none."""
    return c.try_cast("double")


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(c.cast("timestamp"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 3.6e9


def hour_of(c: Column) -> Column:
    """The full hour, of the same type as a timestamp without zone."""
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def in_range(c: Column, lo: float, hi: float) -> Column:
    """Null outside the closed range."""
    return F.when(c.between(lo, hi), c)


def saturate(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Drawn to the nearest bound; null stays null, as least and greatest would not keep it."""
    x = c
    if lo is not None:
        x = F.greatest(x, F.lit(lo))
    if hi is not None:
        x = F.least(x, F.lit(hi))
    return F.when(c.isNotNull(), x)


def steps(c: Column, edges: Sequence[tuple[str, float, int]], other: int = 0) -> Column:
    """The score of the first (operator, bound, score) that holds; null and the rest score `other`."""
    ops = {"<": lambda b: c < b, "<=": lambda b: c <= b, ">": lambda b: c > b, ">=": lambda b: c >= b}
    out = F.lit(None)
    for k, (op, bound, score) in enumerate(edges):
        out = F.when(ops[op](F.lit(bound)), score) if k == 0 else out.when(ops[op](F.lit(bound)), score)
    return out.otherwise(other)


def bucket(c: Column, edges: Sequence[float], labels: Sequence[str], right: bool = True) -> Column:
    """The label of the interval that holds the value: right- or left-closed; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        inside = (c > lo) & (c <= hi) if right else (c >= lo) & (c < hi)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: keeps expressions small however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_number(text: Column) -> Column:
    """The first number in a text, thousands' commas dropped; null without one."""
    return F.regexp_extract(F.regexp_replace(text, ",", ""), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def iso_time(text: Column) -> Column:
    """A timestamp from ISO text: a date, or date and time with or without a zone (`Z` or an offset); null for anything else.

    Times without a zone are in the session's.
    """
    t = F.trim(text)
    full = F.regexp_replace(t, r"([T ]\d{2}:\d{2})(?=$|Z|[+-])", "$1:00")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"), full.try_cast("timestamp"))


def age_at(anchor_age: Column, anchor_year: Column, at: Column) -> Column:
    """The age in the year of a time, from the age in an anchor year; times are shifted, so only years count."""
    return anchor_age + F.year(at) - anchor_year


def shift_of(ts: Column) -> Column:
    """Day from 6, Evening from 14, Night from 22."""
    h = F.hour(ts)
    return F.when(h.between(6, 13), "Day").when(h.between(14, 21), "Evening").otherwise("Night")


def shift_rank(shift: Column) -> Column:
    return F.when(shift == "Day", 0).when(shift == "Evening", 1).when(shift == "Night", 2).otherwise(3)


def shift_cutoff(day: Column, shift: Column) -> Column:
    """The end of a shift: 14:00, 22:00, or 6:00 of the next day for Night."""
    hours = F.when(shift == "Day", 14).when(shift == "Evening", 22).otherwise(30)
    return (day.cast("timestamp_ntz") + F.make_dt_interval(hours=hours)).cast("timestamp_ntz")


def mean_pressure(sbp: Column, dbp: Column, digits: int = 1) -> Column:
    return F.bround((sbp + 2 * dbp) / 3.0, digits)


def contains_map(text: Column, pairs: Sequence[tuple[str, str]], other: Column) -> Column:
    """The value of the first key, in order, that the text holds."""
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs])
    return F.coalesce(F.get(F.filter(known, lambda p: text.contains(p["k"])), F.lit(0))["v"], other)


def sorted_distinct(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def canonical_patient(raw: Column) -> Column:
    """An 8-digit id or T and digits as it is; from patient_<id> or <id>_Patient the id; else null."""
    x = F.upper(F.trim(raw))
    inner = F.coalesce(F.nullif(F.regexp_extract(x, r"^PATIENT_(T?\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"^(T?\d+)_PATIENT$", 1), F.lit("")))
    return F.when(x.rlike(r"^\d{8}$") | x.rlike(r"^T\d+$"), x).otherwise(inner)
