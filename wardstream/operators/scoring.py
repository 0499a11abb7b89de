"""Risk scores: thresholds, tiers, ensembles, factors, as-of features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quantiles import quantiles
from .segments import windows


def roc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, tp, fp, tpr, fpr): one point per distinct score, from the highest.

    Rows are first counted by score; only distinct scores are summed up, in two levels: totals of
    score ranges, then within each range.
    """
    cells = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n"))
    cells = cells.withColumn("range", F.floor(F.col("threshold") * 1000))
    per = cells.groupBy("range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as ranges
    whole = Window.partitionBy()
    per = per.select("range", *[F.coalesce(F.sum(x).over(above), F.lit(0)).alias(f"{x}_above") for x in ("rp", "rn")], F.sum("rp").over(whole).alias("all_p"), F.sum("rn").over(whole).alias("all_n"))
    down = Window.partitionBy("range").orderBy(F.desc("threshold"))
    r = cells.join(per, "range").withColumns({"tp": F.sum("p").over(down) + F.col("rp_above"), "fp": F.sum("n").over(down) + F.col("rn_above")})
    return r.select("threshold", "tp", "fp", F.try_divide(F.col("tp"), F.col("all_p")).alias("tpr"), F.try_divide(F.col("fp"), F.col("all_n")).alias("fpr"))


def thresholds(points: DataFrame, sensitivity: float = 0.85, low_share: float = 0.5) -> DataFrame:
    """One row: high (the least false positives among points of that sensitivity, then the highest score), low, and Youden's best."""
    ok = F.col("tpr") >= sensitivity
    best = F.min_by(F.when(ok, F.col("threshold")), F.when(ok, F.struct("fpr", (-F.col("threshold")).alias("t"))))
    youden = F.max_by("threshold", F.struct((F.col("tpr") - F.col("fpr")).alias("j"), "threshold"))
    return points.agg(best.alias("thresh_high"), (best * low_share).alias("thresh_low"), youden.alias("youden"))


def tier(p: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(p >= lit(high), "High").when(p >= lit(low), "Medium").otherwise("Low")


def level(p: Column, low: float = 0.30, high: float = 0.60) -> Column:
    """Four levels: critical from the higher of 0.85 and high + 0.20."""
    return F.when(p >= max(0.85, high + 0.20), "CRITICAL").when(p >= high, "HIGH").when(p >= low, "MEDIUM").otherwise("LOW")


#: What to do at each tier.
ACTIONS = {"Low": "정기 모니터링 유지", "Medium": "모니터링 강화 | 혈액배양 고려 | 바이탈 1시간마다 재확인", "High": "즉시 담당의 통보 | 상급 처치 가능 여부 점검 | 전원 필요성 평가"}


def action(t: Column, texts: Mapping[str, str] = ACTIONS) -> Column:
    return F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])[t]


def ensemble(folds: Column) -> Column:
    """The mean of the folds' probabilities, between 0 and 1; folds that are null or not finite are left out."""
    ok = F.filter(folds, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    mean = F.try_divide(F.aggregate(ok, F.lit(0.0), lambda a, x: a + x), F.size(ok))
    return F.when(mean.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))


def vector(values: Column, medians: Mapping[str, float | None]) -> Column:
    """Array of struct(feature, value, baseline) in the features' order: a missing or non-finite value becomes the median, or 0."""
    out = []
    for name, m in medians.items():
        v, base = values[name], float(m or 0.0)
        fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        out.append(F.struct(F.lit(name).alias("feature"), F.when(fine, v).otherwise(base).alias("value"), F.lit(base).alias("baseline")))
    return F.array(*out)


def factors(features: Column, contributions: Column, k: int) -> Column:
    """The k features of largest absolute contribution, largest first, ties by name: struct(feature, contribution, shap, direction)."""
    z = F.zip_with(features, contributions, lambda f, s: F.struct((-F.abs(s)).alias("o"), f.alias("feature"), s.alias("s")))
    top = F.slice(F.array_sort(F.filter(z, lambda x: x["s"].isNotNull())), 1, k)
    return F.transform(top, lambda x: F.struct(x["feature"].alias("feature"), F.round(F.abs(x["s"]), 6).alias("contribution"), F.round(x["s"], 6).alias("shap"), F.when(x["s"] >= 0, "UP").otherwise("DOWN").alias("direction")))


def confusion(scored: DataFrame, flag: Column, label: str = "label") -> DataFrame:
    y = F.col(label) == 1
    n = scored.agg(F.count_if(flag & y).alias("tp"), F.count_if(flag & ~y).alias("fp"), F.count_if(~flag & y).alias("fn"), F.count_if(~flag & ~y).alias("tn"))
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 9)
    return n.withColumns({"sensitivity": rate("tp", "fn"), "specificity": rate("tn", "fp"), "precision": rate("tp", "fp")})


def as_of(grid: DataFrame, obs: DataFrame, key: str, at: str, ts: str, row_cols: list[str], value_cols: list[str]) -> DataFrame:
    """For each grid point, the latest row's row_cols (nulls and all) and each value_col's latest non-null, at or before it.

    One union and one sort per key, or per segment of a long key: observations and grid points are put
    in one order, and windows carry the last seen values to the grid points; nothing is joined by time.
    """
    o = obs.select(F.col(key), F.col(ts).alias("_t"), F.lit(0).alias("_g"), F.lit(None).cast(grid.schema[at].dataType).alias(at), F.struct(*row_cols).alias("_row") if row_cols else F.lit(None).alias("_row"), *value_cols)
    g = grid.select(F.col(key), F.col(at).alias("_t"), F.lit(1).alias("_g"), at)
    both = o.unionByName(g, allowMissingColumns=True)
    held = {"_last_row": ("last", "_row")} | {f"_last_{c}": ("last", c) for c in value_cols}
    both = windows(both, key, ["_t", "_g"], held if row_cols else {n: x for n, x in held.items() if n != "_last_row"})
    return both.where("_g = 1").select(key, at, *[F.col("_last_row")[c].alias(c) for c in row_cols], *[F.col(f"_last_{c}").alias(c) for c in value_cols])


def agreement(a: DataFrame, b: DataFrame, keys: list[str], col: str) -> DataFrame:
    j = a.select(*keys, F.col(col).alias("_a")).join(b.select(*keys, F.col(col).alias("_b")), keys)
    return j.agg(F.count("*").alias("n"), F.round(F.avg(F.col("_a").eqNullSafe(F.col("_b")).cast("int")), 9).alias("agreement"))


def medians(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, median): exact, 0 for a feature that the table lacks or that has no number."""
    have = [f for f in features if f in df.columns]
    every = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    if not have:
        return every.withColumn("median", F.lit(0.0))
    q = quantiles(df.select(*[F.col(f).try_cast("double").alias(f) for f in have]), have, [0.5])
    return every.join(q.select("feature", F.get("q", F.lit(0)).alias("m")), "feature", "left").select("feature", F.coalesce("m", F.lit(0.0)).alias("median"))


def kept_medians(spark: SparkSession, path: str, df: DataFrame | None, features: list[str]) -> dict[str, float]:
    """The medians kept as CSV (feature, median); made from df and kept, if there are none yet. As many rows as features."""
    try:
        kept = spark.read.option("header", True).schema("feature string, median double").csv(path)
    except AnalysisException:
        if df is None:
            raise
        medians(df, features).coalesce(1).write.option("header", True).csv(path)
        kept = spark.read.option("header", True).schema("feature string, median double").csv(path)
    return {r["feature"]: r["median"] for r in kept.where("trim(feature) <> ''").collect()}


def kept_thresholds(spark: SparkSession, path: str, low: float = 0.30, high: float = 0.60) -> dict[str, float]:
    """low, high and critical from a CSV (thresh_name, value); the defaults are kept there, if there is none yet."""
    schema = "thresh_name string, value double"
    try:
        kept = spark.read.option("header", True).schema(schema).csv(path)
    except AnalysisException:
        spark.createDataFrame([("thresh_low", low), ("thresh_high", high)], schema).coalesce(1).write.option("header", True).csv(path)
        kept = spark.read.option("header", True).schema(schema).csv(path)
    said = {r["thresh_name"].strip(): r["value"] for r in kept.where("trim(thresh_name) <> ''").collect()}
    top = said.get("thresh_high", high)
    return {"low": said.get("thresh_low", low), "high": top, "critical": max(0.85, top + 0.20)}
