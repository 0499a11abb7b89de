"""Exact quantiles by range refinement.

A group whose rows fit a task is summed up by Spark's exact percentile. A larger one is narrowed
down: an approximate sketch of its values gives two of them that enclose the wanted rank, exact
counts say how many rows lie below, at and between the two, and only the rows between go on, some
hundredth of them in each round. No task holds more than one such rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import few_rows
from ..sources.stages import stage

#: Rows of a group, or of a rest, that one task sorts.
FITS = 1_000_000
#: Values of a sketch, and how exact their ranks are: ten times finer than they are apart.
STEPS, ACCURACY = 256, 2560
#: A table of at most this many groups is broadcast.
BROADCAST_GROUPS = 100_000


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the groups named; a null key is a key."""
    g = groups.withColumnsRenamed({"k": "_k", "feature": "_f"})
    g = F.broadcast(g) if few_rows(groups, BROADCAST_GROUPS) else g
    return rows.join(g, rows["k"].eqNullSafe(g["_k"]) & (rows["feature"] == g["_f"])).drop("_k", "_f")


def _narrowed(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """aims (k, feature, r, low, high, below, inside, value) one round on: a rank within (low, high), `below` rows at or under low."""
    unit = ("k", "feature", "r")
    live = _joined(rows, aims).where("(low IS NULL OR v > low) AND (high IS NULL OR v < high)")
    cuts = live.groupBy(*unit).agg(F.percentile_approx("v", [i / STEPS for i in range(STEPS + 1)], ACCURACY).alias("cuts"), F.first("below").alias("below"), F.first("inside").alias("inside"))
    at = (F.col("r") - F.col("below")) / F.col("inside") * STEPS
    pick = lambda i: F.get("cuts", F.least(F.greatest(i.cast("int"), F.lit(0)), F.lit(STEPS)))
    cuts = stage(cuts.select(*unit, "below", pick(F.floor(at) - 1).alias("lo"), pick(F.ceil(at) + 2).alias("hi")))
    old = aims.select(*unit, "low", "high")
    both = cuts.join(old, (cuts["k"].eqNullSafe(old["k"])) & (cuts["feature"] == old["feature"]) & (cuts["r"] == old["r"])).select(*[cuts[c] for c in cuts.columns], "low", "high")
    live = _joined(rows, both).where("(low IS NULL OR v > low) AND (high IS NULL OR v < high)")
    n = lambda cond: F.count_if(cond)
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    c = live.groupBy(*unit).agg(F.first("below").alias("below"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), n(v < lo).alias("under"), n(v == lo).alias("at"), n((v > lo) & (v < hi)).alias("in"), n((v == hi) & (hi > lo)).alias("top"))
    rel, up_to_lo = F.col("r") - F.col("below"), F.col("under") + F.col("at")
    value = F.when(rel.between(F.col("under"), up_to_lo - 1), F.col("lo")).when(rel.between(up_to_lo + F.col("in"), up_to_lo + F.col("in") + F.col("top") - 1), F.col("hi"))
    held = rel.between(F.col("under"), up_to_lo + F.col("in") + F.col("top") - 1)
    value = F.when(held, value).otherwise(F.raise_error(F.lit("a sketch missed a rank")).cast("double"))
    return stage(c.select(*unit, F.col("lo").alias("low"), F.col("hi").alias("high"), (F.col("below") + up_to_lo).alias("below"), F.col("in").alias("inside"), value.alias("value")))


def _ranked(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """(k, feature, r, value) of ranks whose rest fits a task: equal values are counted before they are sorted."""
    unit = ("k", "feature", "r")
    live = _joined(rows, aims).where("(low IS NULL OR v > low) AND (high IS NULL OR v < high)").groupBy(*unit, "v").agg(F.count("*").alias("n"), F.first("below").alias("below"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*unit).orderBy("v"))
    return live.withColumn("upto", upto).where("r < upto AND r >= upto - n").select(*unit, F.col("v").alias("value"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], key: str | None = None, fits: int = FITS) -> DataFrame:
    """(key, feature, n, q): for each column, over the rows of each key or over all, its exact quantiles as an array of doubles.

    Between two ranks a quantile is interpolated, as SQL's quantile_cont does. Nulls and NaN count
    as missing; a column without any value has no row. A null key is a key. Groups of up to `fits`
    rows take one aggregation; what a larger one costs beyond is two passes over its rows for each
    round, and a round leaves about a hundredth of them.
    """
    rows = df.select((F.col(key) if key else F.lit(None).cast("int")).alias("k"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x"))
    rows = rows.select("k", "x.*").where("v IS NOT NULL AND NOT isnan(v)")
    named = [F.col("k").alias(key)] if key else []
    per = stage(rows.groupBy("k", "feature").agg(F.count("*").alias("n")))
    large = per.where(F.col("n") > fits)
    plain = lambda r: r.groupBy("k", "feature").agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, probs))).alias("q"))
    if large.isEmpty():
        return plain(rows).select(*named, "feature", "n", "q")
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in probs])))
    none = F.lit(None).cast("double")
    aims = stage(large.select("k", "feature", F.explode(ranks).alias("r"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), none.alias("value")))
    known, rests = [], []
    while not aims.isEmpty():
        wide = aims.where((F.col("inside") > fits) & F.col("value").isNull())
        known.append(aims.where("value IS NOT NULL").select("k", "feature", "r", "value"))
        rests.append(aims.where((F.col("inside") <= fits) & F.col("value").isNull()))
        if wide.isEmpty():
            break
        aims = _narrowed(rows, wide)
    found = known[0]
    for x in [*known[1:], *[_ranked(rows, x) for x in rests]]:
        found = found.unionByName(x)
    at = found.groupBy("k", "feature").agg(F.map_from_entries(F.collect_list(F.struct("r", "value"))).alias("at"))  # two for each quantile
    at = at.withColumnsRenamed({"k": "_k", "feature": "_f"})
    big = large.join(at, large["k"].eqNullSafe(at["_k"]) & (large["feature"] == at["_f"])).drop("_k", "_f")

    def between(p: float) -> Column:
        lo, hi, x = F.col("at")[F.floor(place(p))], F.col("at")[F.ceil(place(p))], place(p)
        return F.when(lo == hi, lo).otherwise((F.ceil(x) - x) * lo + (x - F.floor(x)) * hi)

    big = big.select("k", "feature", "n", F.array(*[between(p) for p in probs]).alias("q"))
    g = large.select(F.col("k").alias("_k"), F.col("feature").alias("_f"))
    g = F.broadcast(g) if few_rows(g, BROADCAST_GROUPS) else g
    rest = rows.join(g, rows["k"].eqNullSafe(g["_k"]) & (rows["feature"] == g["_f"]), "left_anti")
    return plain(rest).unionByName(big).select(*named, "feature", "n", "q")


def medians(df: DataFrame, cols: Sequence[str], key: str | None = None, fits: int = FITS) -> DataFrame:
    """(key, _col for each col): one row per key, or one row; null where a column has no value."""
    q = quantiles(df, cols, [0.5], key, fits)
    wide = q.groupBy(*[key] if key else []).agg(*[F.first(F.when(F.col("feature") == c, F.get("q", F.lit(0))), ignorenulls=True).alias(f"_{c}") for c in cols])
    return wide
