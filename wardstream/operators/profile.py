"""Profiles of missing values, correlations and outcomes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def missing(df: DataFrame, cols: tuple[str, ...], label: str | None = None) -> DataFrame:
    """(feature, [label,] n, missing_rate) in one pass over the rows."""
    keys = [label] if label else []
    rates = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c).isNull().cast("int")), 9).alias(c) for c in cols])
    return rates.unpivot([*keys, "n"], list(cols), "feature", "missing_rate").select("feature", *keys, "n", "missing_rate")


def correlations(df: DataFrame, cols: list[str], above: float | None = None) -> DataFrame:
    """(a, b, r) for each pair of columns, in one pass; with `above`, only those of larger absolute value."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.round(F.corr(a, b), 6).alias(f"{a} {b}") for a, b in pairs])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a} {b}").alias("r")) for a, b in pairs])).alias("x")).select("x.*")
    return out if above is None else out.where(F.abs("r") > above)


def flag_odds(df: DataFrame, flag: Column, outcome: Column) -> DataFrame:
    """(flag, n, rate, odds_ratio, verdict) for both values of a flag: CONFIRM where the flag raises the odds."""
    cells = df.select(flag.alias("flag"), outcome.alias("y")).groupBy("flag").agg(F.count("*").alias("n"), F.sum("y").alias("hit"))
    one = cells.agg(*[F.sum(F.when(F.col("flag") == v, x)).cast("double").alias(f"{n}{v}") for v in (0, 1) for n, x in (("hit", F.col("hit")), ("no", F.col("n") - F.col("hit")))])
    odds = F.round(F.try_divide(F.col("hit1") * F.col("no0"), F.col("no1") * F.col("hit0")), 6)
    out = cells.join(F.broadcast(one.select(odds.alias("odds_ratio"))))  # one row
    return out.select("n", "flag", F.round(F.col("hit") / F.col("n"), 9).alias("rate"), "odds_ratio", F.when(F.col("odds_ratio") > 1.0, "CONFIRM").otherwise("REJECT").alias("verdict"))


def spike(df: DataFrame, col: str, value: float) -> DataFrame:
    """The share of one value, severe beyond a half, moderate beyond a fifth."""
    share = F.avg((F.col(col) == value).cast("int"))
    return df.agg(F.round(share, 9).alias("share"), F.when(share > 0.5, "severe").when(share > 0.2, "moderate").otherwise("ok").alias("verdict"))


def retention(df: DataFrame, raw: str, filled: str, label: str) -> DataFrame:
    """The gap of means between label 1 and 0 before and after filling, and how much of it is left."""
    gap = lambda x: F.avg(F.when(F.col(label) == 1, F.col(x))) - F.avg(F.when(F.col(label) == 0, F.col(x)))
    g = df.agg(gap(raw).alias("a"), gap(filled).alias("b"))
    return g.select(F.round("a", 6).alias("raw_gap"), F.round("b", 6).alias("filled_gap"), F.round(F.try_divide(F.col("b"), F.col("a")), 6).alias("retention"))


def describe(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """(feature, n, mean, std, low, p25, p50, p75, high): one pass for all but the percentiles, which are exact; a column without values has nulls."""
    stats = {"n": lambda x: F.count(x), "mean": lambda x: F.round(F.avg(x), 6), "std": lambda x: F.round(F.stddev(x), 6), "low": F.min, "high": F.max}
    one = df.agg(*[F.struct(*[f(F.col(c)).alias(n) for n, f in stats.items()]).alias(c) for c in cols])
    one = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in cols])).alias("x")).select("x.feature", "x.s.*")
    q = quantiles(df, cols, (0.25, 0.5, 0.75)).select("feature", *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])
    return one.join(q, "feature", "left").select("feature", "n", "mean", "std", "low", "p25", "p50", "p75", "high")  # a row for each column


def counters(df: DataFrame, cols: list[str]) -> DataFrame:
    """(kind, name, n): how often each element of the array columns occurs, in one shuffle."""
    named = lambda c: F.transform(c, lambda x: F.struct(F.lit(c).alias("kind"), x.alias("name")))
    every = F.flatten(F.array(*[named(c) for c in cols]))
    return df.select(F.explode(every).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def unit_hash(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that follows from seed and key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296


def part_of(key: Column, seed: int, shares: dict[str, float]) -> Column:
    """Which part a row belongs to, by its hash; the last part takes the rest."""
    out, h = F.lit(list(shares)[-1]), unit_hash(key, seed)
    for name in reversed(list(shares)[:-1]):
        below = round(sum(shares[n] for n in list(shares)[: list(shares).index(name) + 1]), 9)
        out = F.when(h < below, name).otherwise(out)
    return out
