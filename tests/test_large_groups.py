"""Groups larger than a task: quantiles by refinement, segmented windows, panes, joins by time bins."""

import datetime as dt
import random
import statistics
from collections import Counter

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from test_oracles import plain
from wardstream.operators import impute, intervals, panes, quantiles, segments
from wardstream.queries import skewed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["quantiles_by_key", "windows_of_long_keys", "fill_text_keys"])
@pytest.mark.parametrize("fits", [40, 200])
def test_large_way_equals_sql(spark, monkeypatch, name, fits):
    monkeypatch.setattr(skewed, "FITS", fits)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert plain(skewed.R.queries[name](spark, SF).toPandas()) == plain(con.execute(skewed.R.sql[name]).df())


def test_quantiles_of_odd_values(spark):
    rng = random.Random(2)
    rows = [(None, v) for v in (float("inf"), float("-inf"), 1e-300, -0.0, 0.0, 1e300, float("nan"), None)] + [("a", rng.choice([1.0, 1.0, 2.0, rng.random()])) for _ in range(3000)] + [("b", 7.0)] * 900 + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    probs = (0.0, 0.001, 0.5, 0.6, 1.0)
    few, many = ({(r["k"], r["feature"]): (r["n"], r["q"]) for r in quantiles.quantiles(df, ["v"], probs, "k", fits).collect()} for fits in (10**6, 5))
    assert set(few) == {(None, "v"), ("a", "v"), ("b", "v")} and few[None, "v"][0] == 6
    assert {k: (n, [repr(round(x, 12) + 0.0) for x in q]) for k, (n, q) in few.items()} == {k: (n, [repr(round(x, 12) + 0.0) for x in q]) for k, (n, q) in many.items()}
    assert many["a", "v"][1][2] == pytest.approx(statistics.median(v for k, v in rows if k == "a"))
    assert quantiles.quantiles(df.limit(0), ["v"], probs, "k", 5).count() == 0


def test_segments_stay_small_and_ties_stay_together(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 500).alias("k"), (F.col("id") % 4000).alias("t"), "id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("x"))
    _, long = segments.placed(df, "k", ["t", "id"], 1000)
    sizes = [r["count"] for r in long.groupBy("_seg").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 2000 and len(sizes) >= 5
    by = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumn("y", F.last("x", ignorenulls=True).over(by.rowsBetween(-5, 0)))
    got = segments.windows(df, "k", ["t", "id"], {"y": ("last", "x", 5)}, 1000)
    assert want.exceptAll(got).count() == 0 and got.count() == 20_000
    assert segments.windows(df.limit(0), "k", ["t"], {"y": ("sum", "x")}, 10).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_reference_fill_keeps_null_and_text_keys(spark, kind):
    rows = [("1", 1, None), ("1", 2, None), ("2", 1, 5.0), (None, 1, None), (None, 2, 8.0), ("3", 1, None)]
    df = spark.createDataFrame(rows, "k string, t int, v double").withColumn("k", F.col("k").cast(kind))
    got = sorted((r["k"] is None, str(r["k"]), r["t"], r["v"]) for r in impute.fill_both(df, ["v"], "k", "t", mode="reference").collect())
    assert [x[3] for x in got] == [5.0, 5.0, 5.0, 8.0, 8.0, 8.0]
    full = impute.impute(df.withColumnRenamed("v", "hr"), "k", "t", version=2, mode="reference").collect()
    assert len(full) == 6
    assert impute.with_median(df, ["v"], "k").where("k IS NULL AND v = 8.0").count() == 2
    with pytest.raises(ValueError):
        impute.fill_both(df, ["v"], "k", "t", mode="other")


def test_panes_equal_copied_rows_and_shuffle_few(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id") % 7).alias("k"), (F.col("id") % 90).cast("int").alias("h"), F.when(F.col("id") % 4 > 0, (F.col("id") * 37 % 1001).cast("double")).alias("v"), "id")
    spec = {"n": ("count", F.lit(1)), "m": ("median", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "s": ("sum", F.col("v")), "a": ("avg", F.col("v")), "at": ("latest", F.col("v"), F.col("id"))}
    got = panes.sliding(df, "k", *panes.hours("h", 24), spec)
    lo, hi = panes.hours("h", 24)
    copied = df.where(lo <= hi).withColumn("obs", F.explode(F.sequence(lo, hi))).groupBy("k", "obs")
    want = copied.agg(F.count("*").alias("n"), F.median("v").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("s"), F.avg("v").alias("a"), F.max_by("v", "id").alias("at"))
    assert plain(got.toPandas()) == plain(want.toPandas())
    # rows meet in panes before the first shuffle, and windows are made after the second
    assert df.where(lo <= hi).select("k", lo, hi).distinct().count() <= 4 * 90
    text = panes.sliding(df, "k", *panes.hours("h", 24), spec)._jdf.queryExecution().executedPlan().toString()
    assert text.index("Generate") < text.index("Exchange ") and text.count("Exchange ") == 2


def test_bins_meet_few_pairs(spark):
    start = dt.datetime(2024, 1, 1)
    e = spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").alias("e"), (F.lit(start) + F.make_dt_interval(mins=(F.col("id") * 13 % 9973).cast("int"))).alias("ts"))
    a = spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").alias("a"), (F.lit(start) + F.make_dt_interval(mins=(F.col("id") * 29 % 9967).cast("int"))).alias("at"))
    near = intervals.within_band(e, a, "k", "ts", "at", 0.25)
    pairs = near.count()
    at = Counter(y * 29 % 9967 for y in range(10_000))
    assert pairs == sum(at[x * 13 % 9973 + d] for x in range(10_000) for d in range(-15, 16))
    met = e.withColumn("b", F.floor(F.unix_micros("ts") / 9e8)).join(a.withColumn("b", F.explode(F.array(*[F.floor(F.unix_micros("at") / 9e8) + d for d in (-1, 0, 1)]))), ["k", "b"]).count()
    assert met < 2 * pairs
    null = spark.createDataFrame([(1, None, None, None)], "k int, s timestamp, t timestamp, i int")
    i = a.select("k", F.col("at").alias("s"), (F.col("at") + F.make_dt_interval(mins=(F.col("a") % 400).cast("int"))).alias("t"), F.col("a").alias("i"))
    got = intervals.containing(e, i.unionByName(null), "k", "ts", "s", "t")
    want = sum(1 for x in range(0, 10_000, 97) for y in range(10_000) if 0 <= x * 13 % 9973 - y * 29 % 9967 <= y % 400)
    assert got.where("e % 97 = 0").count() == want
    assert intervals.containing(e.limit(0), i, "k", "ts", "s", "t").count() == 0
