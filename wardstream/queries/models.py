"""Queries that score rows by tree ensembles: a fixed model held against SQL, and models fitted by folds of patients."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest, scoring
from .common import Registry, item, measured, table

R = Registry()
c = F.col
#: A small model: tree, node, feature, threshold, left, right, missing, value, cover.
NODES = [
    (0, 0, "quantity", 20.0, 1, 2, 2, None, 100.0), (0, 1, "discount", 0.045, 3, 4, 3, None, 40.0), (0, 2, None, None, None, None, None, 0.3, 60.0), (0, 3, None, None, None, None, None, -0.5, 25.0),
    (0, 4, None, None, None, None, None, 0.1, 15.0),
    (1, 0, "discount", 0.065, 1, 2, 2, None, 100.0), (1, 1, "tax", 0.035, 3, 4, 3, None, 70.0), (1, 2, "discount", 0.085, 5, 6, 6, None, 30.0), (1, 3, None, None, None, None, None, -0.2, 20.0),
    (1, 4, None, None, None, None, None, 0.15, 50.0), (1, 5, None, None, None, None, None, 0.25, 12.0), (1, 6, None, None, None, None, None, 0.6, 18.0),
]
SCHEMA = "tree int, node int, feature string, threshold double, left int, right int, missing int, value double, cover double"
FEATURES = ["quantity", "discount", "tax"]
#: The game of the contributions: what the model is expected to say, if only the features of s are known (bits 1, 2, 4). Every set is tried.
SETS = """l AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER () AS i, l_quantity AS q, CASE WHEN l_linenumber % 5 <> 0 THEN l_discount END AS d, l_tax AS t FROM lineitem),
g AS (SELECT l.*, s, CASE WHEN s & 1 = 0 THEN 0.4 WHEN q < 20 THEN 1 ELSE 0 END AS q1, CASE WHEN s & 2 = 0 THEN 25 / 40.0 WHEN d IS NULL OR d < 0.045 THEN 1 ELSE 0 END AS d1, CASE WHEN s & 2 = 0 THEN 0.7 WHEN d < 0.065 THEN 1 ELSE 0 END AS d2,
  CASE WHEN s & 2 = 0 THEN 0.4 WHEN d < 0.085 THEN 1 ELSE 0 END AS d3, CASE WHEN s & 4 = 0 THEN 20 / 70.0 WHEN t < 0.035 THEN 1 ELSE 0 END AS t1 FROM l, range(8) r(s)),
v AS (SELECT *, CAST(q1 * (d1 * -0.5 + (1 - d1) * 0.1) + (1 - q1) * 0.3 + d2 * (t1 * -0.2 + (1 - t1) * 0.15) + (1 - d2) * (d3 * 0.25 + (1 - d3) * 0.6) AS DOUBLE) AS v FROM g)"""
_PHI = ", ".join(
    f"round(sum(v * CASE WHEN s & {b} = {b} THEN 1 ELSE -1 END * CASE bit_count((s & ~{b})::INT) WHEN 1 THEN 1 / 6.0 ELSE 1 / 3.0 END), 6) + 0.0 AS {n}" for n, b in zip(FEATURES, (1, 2, 4))
)


@R.add(f"""WITH {SETS} SELECT l_orderkey, l_partkey, l_linenumber, round(sum(v) FILTER (WHERE s = 7), 6) AS margin, round(sum(v) FILTER (WHERE s = 0), 6) AS base, {_PHI} FROM v GROUP BY i, l_orderkey, l_partkey, l_linenumber""")
def forest_contributions(spark, sf):
    """Score, base and each feature's exact contribution, where one feature is missing in some rows and one is asked twice on a path."""
    model = forest.forest(spark.createDataFrame(NODES, SCHEMA), FEATURES)
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", c("l_quantity").alias("quantity"), F.when(c("l_linenumber") % 5 != 0, c("l_discount")).alias("discount"), c("l_tax").alias("tax"))
    e = forest.explain(l, model)
    return e.select("l_orderkey", "l_partkey", "l_linenumber", F.round("explained.margin", 6).alias("margin"), F.lit(round(model.base, 6)).alias("base"), *[(F.round(F.get("explained.contributions", F.lit(i)), 6) + 0.0).alias(n) for i, n in enumerate(FEATURES)])


DAILY = ["n", "clicks", "views", "highest", "spread"]


def stay_days(spark, sf):
    """A stay's days with features of the day, and whether the next one brings an error; null where there is no next day."""
    m = measured(spark, sf).withColumn("day", F.floor(c("h") / 24).cast("int"))
    days = m.groupBy("user_id", "day").agg(
        F.count("*").alias("n"), F.count(item("click")).alias("clicks"), F.avg(item("view")).alias("views"), F.max("value").alias("highest"), F.stddev("value").alias("spread"),
        F.max((c("event_type") == "error").cast("int")).alias("bad"), F.max(F.floor(F.timestamp_diff("HOUR", "t0", "t1") / 24)).cast("int").alias("last"),
    )
    after = days.select("user_id", (c("day") - 1).alias("day"), c("bad").alias("_bad"))
    return days.join(after, ["user_id", "day"], "left").withColumn("label", F.when(c("day") < c("last"), F.coalesce("_bad", F.lit(0)))).drop("_bad", "bad", "last")


@R.add()
def out_of_fold_scores(spark, sf):
    """Each stay-day's score by a model that saw no day of its stay, with its two strongest factors."""
    o = forest.out_of_fold(stay_days(spark, sf), "user_id", "label", DAILY)
    return o.select("user_id", "day", "fold", "label", "score", "base", scoring.factors(F.array(*map(F.lit, DAILY)), c("contributions"), 2).alias("factors"))
